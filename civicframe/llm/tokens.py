"""Tokenization, and token counts attributed to sections by offsets.

A text is encoded once, whole. The tokens' byte spans are joined to the sections' byte spans as intervals, and a token that
crosses a boundary goes to the section that holds its first byte.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices, utf8

#: Parts kept by the encoder of a worker, in two generations, so that its memory stays bounded and frequent parts stay known.
CACHE = 500_000
#: Text of these characters alone is split here: printable ASCII, white space, and the letters of Latin-1. All are stable under NFC.
PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: White space to Python but not to the tokenizer.
ODD = re.compile("[\x1c-\x1f\x85]")
#: The settings of a tokenizer file under which the encoder splits texts itself; files with others are used as they are.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Values of a function by key. When half of ``CACHE`` is full, what isn't used again before the next time is forgotten."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE // 2:
            self.old = dict(self)
            self.clear()
        got = self.old.pop(key, None)
        self[key] = value = self.make(key) if got is None else got
        return value


def _splits_alike(path: str) -> bool:
    """Whether the file's texts are lower-cased, split by ``SPLIT`` and encoded part by part, none joined to another."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, *bytes_of = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    plain_bytes = len(bytes_of) == 1 and bytes_of[0].get("type") == "ByteLevel" and not bytes_of[0].get("use_regex") and not bytes_of[0].get("add_prefix_space")
    removed = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex") == SPLIT
    return (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and bool(removed) and plain_bytes and not spec["post_processor"] and not spec["truncation"] and not spec["padding"]


@cache
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts to little-endian 32-bit ids, as ``encode(text, add_special_tokens=False)`` does.

    Where the file's settings are those above, a text of plain letters is split into the parts that the tokenizer encodes one by one, and each part is
    encoded only the first time a worker sees it; other texts go through the whole tokenizer by their pieces between white space. Any other file encodes whole texts.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    if not _splits_alike(path):
        return whole
    model, specials = t.model, [x.content for x in t.get_added_tokens_decoder().values()]
    part = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    letters = _byte_letters()

    def of_part(x: str) -> bytes:
        shown = x if x.isascii() else x.encode().decode("latin-1").translate(letters)
        return b"".join([y.id.to_bytes(4, "little") for y in model.tokenize(shown)])

    parts, pieces = _Known(of_part), _Known(lambda x: whole([x])[0])

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            special = any(x in text for x in specials)
            if not special and PLAIN.fullmatch(text):
                out.append(b"".join(map(parts.__getitem__, part.findall(text.lower()))))
            elif special or ODD.search(text):
                out.append(whole([text])[0])
            else:
                out.append(b"".join(map(pieces.__getitem__, text.split())))
        return out

    return encode


@cache
def byte_encoder(path: str, pattern: str):
    """The encoder of a file of ranks, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


#: A whole run of white space that the splitting pattern's matcher had better not see: it goes deeper with each character.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = re.compile(f"(?<![{SPACE}])[{SPACE}]{{10000,}}")


def encoded(encoding, text: str) -> list[int]:
    """The ids of a text. In a long run of white space the pattern finds one piece: all of it, but for a last character before a word, so it is encoded as that."""
    out: list[int] = []
    at = 0
    for m in LONG.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def sections(raw: bytes) -> np.ndarray:
    """Byte starts of the sections: a section is a line with the line end after it. An empty text has one empty section."""
    at, starts = raw.find(b"\n"), [0]
    while at >= 0 and at + 1 < len(raw):
        starts.append(at + 1)
        at = raw.find(b"\n", at + 1)
    return np.array(starts, np.int64)


def attribute(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Section starts and ends, tokens of each section, and those of them that reach into a later one. lengths: of the tokens, in bytes."""
    starts = sections(raw)
    ends = np.append(starts[1:], len(raw))
    stop = np.cumsum(lengths)
    owner = np.searchsorted(starts, stop - lengths, side="right") - 1
    crossing = stop > ends[owner] if len(owner) else np.zeros(0, bool)
    return starts, ends, np.bincount(owner, minlength=len(starts)), np.bincount(owner, weights=crossing, minlength=len(starts)).astype(np.int64)


def counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per section: doc_id, section (from 0), start_byte, end_byte, n_tokens, n_crossing, doc_tokens.

    The sections of a document tile its text, and their n_tokens add up to doc_tokens. Null and empty texts have one empty
    section without tokens. Repeated rows are counted each; other columns are ignored. The pattern has to take white space as the public
    one does: a run but for the last character before a word. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = byte_encoder(path, pattern)
        for b in slices(batches, 256):
            n, parts = [], []
            for raw in utf8(b, "text"):
                raw = raw or b""
                tokens = encoded(encoding, raw.decode("utf-8"))
                got = attribute(raw, size[np.array(tokens, np.int64)])
                n.append(len(got[0]))
                parts.append((*got, np.full(len(got[0]), len(tokens), np.int64)))
            rows = np.repeat(np.arange(len(n)), n)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
            order = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(order), *(pa.array(c.astype(np.int64)) for c in cols)], names=["doc_id", "section", "start_byte", "end_byte", "n_tokens", "n_crossing", "doc_tokens"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section long, start_byte long, end_byte long, n_tokens long, n_crossing long, doc_tokens long")
