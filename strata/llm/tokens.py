"""Byte-level BPE with the public 50k vocabulary; files are read where they lie, never copied."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import public_tokenizers
import tiktoken

END_TEXT, END_ID = "<|endoftext|>", 50256
#: The id that closes each document in packed sequences and id files.
CLOSE_ID = 0


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    follow from code point 256 in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def from_json(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file of the tokenizers library: its ids are merge ranks,
    so the same merges run in tiktoken's core, several times as fast. As in that library, the
    end-of-text string inside a text is its special id."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t != END_TEXT}
    return tiktoken.Encoding("byte_bpe_json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT: END_ID})


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_json(path: str, text: str) -> np.ndarray:
    """The ids of one text. Where tiktoken's pattern engine gives up (a run of some hundred thousand
    spaces), the tokenizers library encodes the text itself."""
    try:
        return from_json(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def from_ranks(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file, without special tokens."""
    return tiktoken.Encoding("byte_bpe_ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(path), special_tokens={})
