"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The words of many texts that the cache doesn't hold are laid out as symbols in one flat array. In each round all
pairs of neighbours are looked up by binary search in the sorted pair keys, and every word merges its pair of lowest
rank, until no word has a pair left. A text's ids are the joined ids of its words.

A null text is an empty one and has no ids. Words of any length are merged whole. Repeated rows give equal rows; a
column to keep that has the name of an added one (``n_tokens``, ``ids``, ...) gives way to it. The vocabulary file is a
parameter; executors open it at the same path. What a file asks for beyond plain byte-level merges (a normalizer, a
prefix space, whole words before merges, dropout, added tokens that match in other ways) is refused.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import beside

#: Splits a text into words before merging (fixed value, the byte-level pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task remembers; when more are seen, it starts anew.
CACHE_WORDS = 200_000
#: Bytes of text whose unknown words are merged together; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20
_NONE = np.int64(1) << np.int64(40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _refuse_unsupported(spec: dict) -> None:
    """Raises where a tokenizer file asks for work that this module doesn't do."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in (
            ("model type", model.get("type", "BPE") != "BPE"),
            ("dropout", bool(model.get("dropout"))),
            ("ignore_merges", bool(model.get("ignore_merges"))),
            ("byte_fallback", bool(model.get("byte_fallback"))),
            ("subword prefix or suffix", bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))),
            ("normalizer", spec.get("normalizer") is not None),
            ("pre-tokenizer", before.get("type") != "ByteLevel" or before.get("use_regex") is False),
            ("prefix space", bool(before.get("add_prefix_space"))),
            ("decoder", (spec.get("decoder") or {}).get("type") != "ByteLevel"),
            ("added tokens that strip or match words", any(t.get(f) for t in spec.get("added_tokens", []) for f in ("lstrip", "rstrip", "single_word"))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"the tokenizer file needs what isn't supported: {', '.join(wrong)}")


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file, encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_unsupported(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        # the last key is above any pair, so that a search always ends at one
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.rank = np.append(order.astype(np.int64), _NONE)
        self.merged = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64)[order], 0)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(max(vocab.values()), max(special.values(), default=0)) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        self.tokens = tokens
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in raw], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        while len(ids):
            # rank of the pair that starts at each symbol; none at a word's last
            rank = np.full(len(ids), _NONE)
            key = (ids[:-1] << 32) | ids[1:]
            at = np.searchsorted(self.keys, key)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][found] = self.rank[at[found]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            done = best == _NONE
            if done.any():
                data = ids.astype("<u4").tobytes()
                for k, a, n in zip(word[first[done]].tolist(), first[done].tolist(), size[done].tolist()):
                    out[k] = data[4 * a : 4 * (a + n)]
            hit = (rank == np.repeat(best, size)) & (rank != _NONE)
            h = np.flatnonzero(hit)
            if len(h):  # of overlapping pairs of one symbol every second is merged, from the left
                run = np.concatenate([[True], np.diff(h) != 1])
                begin = h[run][np.cumsum(run) - 1]
                h = h[(h - begin) % 2 == 0]
                spot = np.searchsorted(self.keys, (ids[h] << 32) | ids[h + 1])
                ids[h] = self.merged[spot]
            keep = ~np.repeat(done, size)
            keep[h + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        self.cache.update(zip(new, self.merge(new)))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts, a = [], 0
            for m in self.marks.finditer(text) if self.marks else ():
                parts += [self.pattern.findall(text[a : m.start()]), m.group()]
                a = m.end()
            parts.append(self.pattern.findall(text[a:] if a else text))
            split.append(parts)
        self.learn(set(chain.from_iterable(p for parts in split for p in parts if isinstance(p, list))))
        get = self.cache.__getitem__
        return [b"".join(self.special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.length[i]
        end = np.cumsum(size)
        if not len(end):
            return ""
        return self.flat[np.repeat(self.start[i] - end + size, size) + np.arange(end[-1])].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _slices(batch: pa.RecordBatch):
    """Runs of a batch's rows whose texts have about CHUNK_CHARS bytes, at least one row each."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + CHUNK_CHARS, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _coded(path: str, digest: bool):
    def run(batches):
        v = vocabulary(path)
        for part in (x for batch in batches for x in _slices(batch)):
            ids = v.encode_many([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digest:
                more = [
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(v.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                more, names = [pa.ListArray.from_arrays(pa.array(ends), flat)], ["n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], n, *more], [*part.schema.names[:-1], *names])

    return run


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``n_tokens`` and the ``ids`` of its whole text."""
    rows, schema = beside(docs, keep, text_col, "n_tokens long, ids array<int>")
    return rows.mapInArrow(_coded(path, False), schema)


def round_trip(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` and digests of the ids and of the text decoded from them."""
    rows, schema = beside(docs, keep, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(_coded(path, True), schema)


def decode(docs: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` with the ``text`` of the ids; null ids give a null text."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else v.decode(np.array(x, "<u4").tobytes()) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    rows, schema = beside(docs, keep, ids_col, "text string")
    return rows.mapInArrow(run, schema)
