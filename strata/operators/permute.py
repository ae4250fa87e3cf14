"""exact shuffled batches by a format-preserving permutation.

Rows get gapless numbers 0 .. n-1 (ranges of the id and their offsets, no one-task sort). A keyed
permutation of 0 .. n-1 then gives each row its place in the shuffled order, from its number alone:
in every round a number x either stays or swaps with key - x (mod n), as a hash of the pair says. Both
partners see the same hash, so each round, and the whole, is a bijection for any n, and
running the rounds backwards finds the rows of any batch without shuffling anything.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.text import col_of
from strata.operators.features import number_by

ROUNDS = 32


def round_keys(n: int, seed, rounds: int = ROUNDS) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{r}".encode()).hexdigest()[:15], 16) % n for r in range(rounds)]


def permuted(row: str | Column, n: int, seed, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """The place of a row number in the shuffled order of ``n`` rows (``inverse``: the number at a place)."""
    keys = list(enumerate(round_keys(n, seed, rounds)))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).cast("bigint").alias("k")) for r, k in (reversed(keys) if inverse else keys)])

    def swap(x: Column, s: Column) -> Column:
        other = F.pmod(s["k"] - x, F.lit(n))
        named = F.concat_ws(":", F.lit(str(seed)), s["r"].cast("string"), F.greatest(x, other).cast("string"))
        return F.when(F.conv(F.substring(F.md5(named), 1, 1), 16, 10).cast("int") % 2 == 1, other).otherwise(x)

    return F.aggregate(steps, col_of(row).cast("bigint"), swap)


def rows_of_batch(batch: int, n: int, batch_size: int, seed, rounds: int = ROUNDS) -> list[int]:
    """The row numbers of one batch, in its order, computed alone."""
    keys = round_keys(n, seed, rounds)
    out = []
    for x in range(batch * batch_size, min((batch + 1) * batch_size, n)):
        for r in range(rounds - 1, -1, -1):
            other = (keys[r] - x) % n
            if int(hashlib.md5(f"{seed}:{r}:{max(x, other)}".encode()).hexdigest()[0], 16) % 2:
                x = other
        out.append(x)
    return out


def exact_batches(df: DataFrame, batch_size: int = 16, seed=42, id_col: str = "id") -> DataFrame:
    """df + row_no (by id), position (its place in the shuffled order), batch_id and slot: every batch
    but the last has exactly ``batch_size`` rows. Ids are unique."""
    # The numbered table is written, so its count is a read of its footers.
    numbered = number_by(df, [F.col(id_col).asc()], 0, "numbered").withColumnRenamed("token_id", "row_no")
    n = numbered.count()
    place = permuted("row_no", n, seed) if n else F.lit(0).cast("bigint")
    return (numbered.withColumn("position", place).withColumn("batch_id", F.expr(f"position div {batch_size}"))
            .withColumn("slot", F.col("position") % batch_size))


def shuffled_export(df: DataFrame, path: str, rows_per_file: int, batch_size: int = 16, seed=42, id_col: str = "id") -> None:
    """Rows in the shuffled order, about ``rows_per_file`` a file; files, and rows in them, follow the
    order, so a reader gets whole batches one after the other."""
    placed = exact_batches(df, batch_size, seed, id_col)
    files = max(1, -(-placed.count() // rows_per_file))
    placed.repartitionByRange(files, "position").sortWithinPartitions("position").write.mode("overwrite").parquet(path)
