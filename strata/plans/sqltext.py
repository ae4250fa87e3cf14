"""DuckDB-dialect SQL twins of the fixtures and operators, used as oracles.

Each helper returns a CTE body; ``catalog`` glues them into full statements.
"""

from __future__ import annotations

from strata.operators.features import CHAR_PATTERN
from strata.sources.corpus import LANG_CODES, OTHER_CODE, head
from strata.functions.text import CLEAN_PATTERN, TOKEN_SPLIT
from strata.operators.split import INTERCEPT, SLOPE


def lit(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, float):
        return f"cast({x!r} as double)"
    return str(x)


def corpus(nulls: bool = False) -> str:
    case = " ".join(f"when '{k}' then '{v}'" for k, v in sorted(LANG_CODES.items()))
    texts = []
    for i, name in enumerate(("text_obj", "text_mthd", "text_deal"), start=1):
        part = (f"split_part(text, chr(10), {i})" if i < 3
                else "array_to_string(string_split(text, chr(10))[3:], chr(10))")
        texts.append(f"nullif({part}, '') as {name}" if nulls else f"coalesce({part}, '') as {name}")
    return (f"select doc_id as id, case lang {case} else '{OTHER_CODE}' end as digit_1, "
            f"cast(floor(n_chars/10000.0) as int) as digit_2, cast(floor(n_chars/1000.0) as int) as digit_3, "
            + ", ".join(texts) + " from documents")


def pad(expr: str, d: int) -> str:
    s = f"coalesce(cast({expr} as varchar), '')"
    return f"(case when length({s}) < {d} then lpad({s}, {d}, '0') else {s} end)"


def code(d1="digit_1", d2="digit_2", d3="digit_3") -> str:
    return f"(coalesce({d1}, '') || {pad(d2, 2)} || {pad(d3, 3)})"


KEYS = "digit_1, digit_2, digit_3, text_obj, text_mthd, text_deal"
TEXTS = "text_obj, text_mthd, text_deal"
NON_EMPTY = ("(coalesce(length(text_obj), 0) > 0 or coalesce(length(text_mthd), 0) > 0 "
             "or coalesce(length(text_deal), 0) > 0)")


def h(*parts: str) -> str:
    """H(x) = first 15 hex digits of md5('p1:p2:...') as bigint."""
    return f"cast(('0x' || substr(md5({key(*parts)}), 1, 15)) as bigint)"


def key(*parts: str) -> str:
    return "(" + " || ':' || ".join(f"cast({p} as varchar)" for p in parts) + ")"


def clean(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(CLEAN_PATTERN)}, '', 'g')"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(TOKEN_SPLIT)}), lambda x: x <> '')"


def base_ctes(seed=42, test_ratio: float | str = 0.1) -> str:
    """(test_ratio: a number or an SQL expression) corpus -> dedup -> coded -> classes -> labelled -> split, as CTEs."""
    quota = (f"least(case when n < 3 then 0 when n <= 5 then 1 when n <= 10 then 2 "
             f"when n < 100 then floor({lit(SLOPE)} * n + {lit(INTERCEPT)}) "
             f"else floor(n * {test_ratio if isinstance(test_ratio, str) else lit(float(test_ratio))}) end, n)")
    return f"""corpus as ({corpus()}),
dedup as (select min(id) as id, {KEYS} from corpus group by {KEYS}),
coded as (select id, digit_1, {pad('digit_2', 2)} as digit_2, {pad('digit_3', 3)} as digit_3, {TEXTS},
          {code()} as digit from dedup),
classes as (select digit, count(*) as n, cast(row_number() over (order by digit) - 1 as int) as label
            from coded group by digit),
labelled as (select c.*, k.label, k.n from coded c join classes k using (digit)),
ranked as (select *, row_number() over (partition by label order by md5({key(lit(str(seed)), 'id')}), id) as rk,
           {quota} as k from labelled),
split as (select *, case when rk <= k then 'test' else 'train' end as part from ranked),
train as (select label, id, {TEXTS} from split where part = 'train')"""


def matrix(w: list[list[float]]) -> str:
    return "cast([" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in w) + "] as double[][])"


def softmax_of(z: str) -> str:
    """Softmax of a list expression, as a list."""
    e = f"list_transform({z}, lambda v: exp(v - list_max({z})))"
    return f"list_transform({e}, lambda v: v / list_sum({e}))"


def scores_of(x: str, w: str, c: int, scale: float = 1.0, b: str | None = None) -> str:
    """[scale * w[1].x, ...] (+ b) for a matrix expression."""
    return "[" + ", ".join(f"list_inner_product({x}, {w}[{i}]) * {lit(float(scale))}" + (f" + {b}[{i}]" if b else "") for i in range(1, c + 1)) + "]"


def logits_ctes(member: int = 0, num_classes: int = 10, scale: float = 10.0) -> str:
    """z (score vector of the fixed head over all dimensions), softmax p and argmax pred per embeddings row."""
    return f"""hd as (select {matrix(head(member, num_classes))} as w),
z as (select vec_id as id, cast(label as int) as label, {scores_of('cast(embedding as double[])', 'w', num_classes, scale)} as z from embeddings, hd),
sm as (select id, label, z, {softmax_of('z')} as p, cast(list_position(z, list_max(z)) - 1 as int) as pred from z)"""


def descent_ctes(name: str, rows: str, steps: int, lr: float, gamma: float, start: str | None = None,
                 num_classes: int = 10, dims: int = 64, eps: float = 1e-9, l2: float = 0.0) -> str:
    """{name}0 .. {name}{steps}: (w, b) after each full-batch step of the focal loss (gamma 0: cross
    entropy, plus l2/2 of all squared parameters) on ``rows`` (x, label); starts from zeros or from the CTE ``start``."""
    zero = f"select {matrix([[0.0] * dims] * num_classes)} as w, cast({[0.0] * num_classes} as double[]) as b"
    out = [f"{name}0 as materialized ({f'select w, b from {start}' if start else zero})"]
    g = lit(float(gamma))
    d_u = f"-pow(1.0 - u, {g}) / (u + {lit(eps)})" + (f" + {g} * pow(greatest(1.0 - u, 1e-12), {lit(float(gamma) - 1)}) * ln(u + {lit(eps)})" if gamma else "")
    for k in range(steps):
        w = f"{name}{k}"
        out.append(f"""{w}_p as materialized (select x, label, {softmax_of('z')} as p from (select x, label, {scores_of('x', 'w', num_classes, 1.0, 'b')} as z from {rows}, {w})),
{w}_d as materialized (select x, label, list_transform(range(0, {num_classes}), lambda c: ({d_u}) * u * (cast(c = label as int) - p[c + 1])) as dz from (select *, p[label + 1] as u from {w}_p)),
{w}_g as materialized (select c, list(g order by d) as gw from (select c, d, sum(dz[c + 1] * x[d]) as g from {w}_d, unnest(range(0, {num_classes})) as a(c), unnest(range(1, {dims} + 1)) as e(d) group by c, d) group by c),
{w}_b as materialized (select c, sum(dz[c + 1]) as gb from {w}_d, unnest(range(0, {num_classes})) as a(c) group by c),
{name}{k + 1} as materialized (select list(list_transform(range(1, {dims} + 1), lambda d: w[c + 1][d] - {lit(float(lr))} * (gw[d] / n + {lit(float(l2))} * w[c + 1][d])) order by c) as w,
   list(b[c + 1] - {lit(float(lr))} * (gb / n + {lit(float(l2))} * b[c + 1]) order by c) as b from {w}_g join {w}_b using (c), {w}, (select count(*) as n from {rows}))""")
    return ",\n".join(out)


def chars(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(CHAR_PATTERN)})"


def vocab_cte(name: str, tok_sql: str) -> str:
    """(token, token_id, n) for every token of documents."""
    return f"""{name}_c as (select token, count(*) as n from (select unnest({tok_sql}) as token from documents) group by token),
{name} as (select token, cast(row_number() over (order by n desc, token) + 1 as bigint) as token_id, n
           from {name}_c)"""


def encode_cte(name: str, voc: str, tok_sql: str, max_len: int) -> str:
    """(id, ids) with ids the padded id list as a comma string."""
    return f"""{name}_t as (select doc_id as id, ({tok_sql})[1:{max_len}] as toks from documents),
{name}_p as (select id, generate_subscripts(toks, 1) as pos, unnest(toks) as token from {name}_t),
{name}_l as (select p.id, list(coalesce(v.token_id, 1) order by p.pos) as ids from {name}_p p left join {voc} v using (token) group by p.id),
{name} as (select t.id, coalesce(len(l.ids), 0) as valid_length,
           array_to_string(list_resize(coalesce(l.ids, []), {max_len}, 0), ',') as ids
           from {name}_t t left join {name}_l l using (id))"""


def permuted(row: str, n: str, seed, rounds: int) -> str:
    """The place of row number ``row`` of ``n`` in the shuffled order (see operators.permute)."""
    k = f"(cast('0x' || substr(md5('{seed}:' || r), 1, 15) as bigint) % {n})"
    other = f"((({k} - x) % {n} + {n}) % {n})"
    return (f"list_reduce(cast(range(0, {rounds}) as bigint[]), lambda x, r: case when cast('0x' || substr(md5('{seed}:' || r || ':' || greatest(x, {other})), 1, 1) as int) % 2 = 1 "
            f"then {other} else x end, cast({row} as bigint))")


def _sum_outer(rows: str, a: str, i: int, b: str, j: int) -> str:
    """The sum over rows of a b^T, as a list of lists."""
    return (f"(select list(g order by i) from (select i, list(g order by j) as g from (select i, j, sum({a}[i] * {b}[j]) as g from {rows}, unnest(range(1, {i + 1})) as p(i), "
            f"unnest(range(1, {j + 1})) as q(j) group by i, j) group by i))")


def _sum_of(rows: str, a: str, i: int, fn: str = "sum") -> str:
    return f"(select list(g order by i) from (select i, {fn}({a}[i]) as g from {rows}, unnest(range(1, {i + 1})) as p(i) group by i))"


def relu_ctes(name: str, rows: str, start: dict[str, list], steps: int, lr: float, dropout: float, seed, dims: int, hidden: int, num_classes: int, eps: float = 1e-5) -> str:
    """{name}0 .. {name}{steps}: (w1, b1, gain, shift, w2, b2) of a head of one hidden layer (dropout, linear, batch
    normalization, ReLU, dropout, linear) after each full-batch step on ``rows`` (id, label, x)."""
    cut = int(dropout * 256)
    keep = lit(256 / (256 - cut))

    def mask(step: int, layer: int, units: int) -> str:
        byte = f"cast('0x' || substr(md5('{seed}:{step}:{layer}:' || id || ':' || (j // 16)), 1 + 2 * (j % 16), 2) as int)"
        return f"list_transform(range(0, {units}), lambda j: case when {byte} < {cut} then 0.0 else {keep} end)"

    each = lambda n, e: f"list_transform(range(1, {n + 1}), lambda h: {e})"
    move = lambda what, g: f"{what} - {lit(float(lr))} * {g} / n"
    out = [f"{name}0 as materialized (select {matrix(start['w1'])} as w1, {lit_list(start['b1'])} as b1, {lit_list(start['gain'])} as gain, {lit_list(start['shift'])} as shift, "
           f"{matrix(start['w2'])} as w2, {lit_list(start['b2'])} as b2)"]
    for k in range(steps):
        s = f"{name}{k}"
        out.append(f"""{s}_a as materialized (select id, label, {each(dims, "x[h] * m[h]")} as x, {mask(k, 1, hidden)} as m2 from (select *, {mask(k, 0, dims)} as m from {rows})),
{s}_z as materialized (select a.*, {each(hidden, "list_inner_product(x, w1[h]) + b1[h]")} as z from {s}_a a, {s}),
{s}_m as materialized (select {_sum_of(f"{s}_z", "z", hidden, "avg")} as mu, {_sum_of(f"{s}_z", "z", hidden, "var_pop")} as va, (select count(*) from {s}_z) as n),
{s}_h as materialized (select id, label, x, m2, {each(hidden, f"(z[h] - mu[h]) / sqrt(va[h] + {lit(eps)})")} as hat from {s}_z, {s}_m),
{s}_o as materialized (select h.*, {each(hidden, "hat[h] * gain[h] + shift[h]")} as o from {s}_h h, {s}),
{s}_r as materialized (select *, {each(hidden, "greatest(o[h], 0.0) * m2[h]")} as r from {s}_o),
{s}_p as materialized (select t.*, {softmax_of('z2')} as p from (select q.*, {scores_of('r', 'w2', num_classes, 1.0, 'b2')} as z2 from {s}_r q, {s}) t),
{s}_d as materialized (select id, x, r, m2, hat, o, list_transform(range(0, {num_classes}), lambda c: p[c + 1] - cast(c = label as int)) as dz from {s}_p),
{s}_y as materialized (select d.*, {each(hidden, "list_sum(list_transform(range(1, " + str(num_classes + 1) + "), lambda c: dz[c] * w2[c][h])) * m2[h] * cast(o[h] > 0 as int)")} as dy from {s}_d d, {s}),
{s}_t as materialized (select *, {each(hidden, "dy[h] * hat[h]")} as dyh from {s}_y),
{s}_s as materialized (select {_sum_of(f"{s}_t", "dy", hidden)} as s1, {_sum_of(f"{s}_t", "dyh", hidden)} as s2),
{s}_i as materialized (select x, {each(hidden, f"gain[h] / sqrt(va[h] + {lit(eps)}) * (dy[h] - s1[h] / n - hat[h] * s2[h] / n)")} as dz1 from {s}_t, {s}_m, {s}_s, {s}),
{s}_g as materialized (select {_sum_outer(f"{s}_i", "dz1", hidden, "x", dims)} as g1, {_sum_of(f"{s}_i", "dz1", hidden)} as c1, {_sum_outer(f"{s}_d", "dz", num_classes, "r", hidden)} as g2, {_sum_of(f"{s}_d", "dz", num_classes)} as c2),
{name}{k + 1} as materialized (select {each(hidden, f"list_transform(range(1, {dims + 1}), lambda d: {move('w1[h][d]', 'g1[h][d]')})")} as w1, {each(hidden, move('b1[h]', 'c1[h]'))} as b1,
   {each(hidden, move('gain[h]', 's2[h]'))} as gain, {each(hidden, move('shift[h]', 's1[h]'))} as shift,
   {each(num_classes, f"list_transform(range(1, {hidden + 1}), lambda d: {move('w2[h][d]', 'g2[h][d]')})")} as w2, {each(num_classes, move('b2[h]', 'c2[h]'))} as b2 from {s}, {s}_g, {s}_s, {s}_m)""")
    return ",\n".join(out)


def lit_list(v) -> str:
    return "cast([" + ", ".join(repr(float(x)) for x in v) + "] as double[])"
