"""BPE encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolake.llm._common import hold, release_memory

#: Stands for the end of a word behind its last byte; never occurs in UTF-8.
WORD_END = b"\xff"
#: Entries of each memo of chunks and fragments in a Python worker.
MEMO = 100_000
#: Characters for which Python's and the library's rules for case, composition and white space agree.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xff]")
_NO_CUT = re.compile(r"\s ")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """Computes what it lacks; emptied when full, so that it never grows with the corpus."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class ForcedBoundaryBpe:
    """Encodes as the tokenizers library does with a byte-level BPE file, fragment by fragment.

    Byte pairs that occur inside no vocabulary token can never be joined by a merge, so a text is cut there for certain. White
    space is such a boundary in both supported kinds (with ``end_of_word_suffix``: white space dropped, words end
    with a mark; without: a single space belongs to what follows). Chunks between spaces are split into pre-tokens
    as the file says; pre-tokens are cut at every impossible byte pair; fragments are encoded
    independently, each distinct one once as long as the memo holds it; ids are concatenated. Texts with characters beyond
    Latin-1 are normalised and pre-tokenised by the library itself.
    """

    def __init__(self, spec_json: str):
        spec = json.loads(spec_json)
        self.library = Tokenizer.from_str(spec_json)
        model, letters = spec["model"], _byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.end = WORD_END if self.suffix else b""
        if self.suffix:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.find = regex.compile(pattern).findall
        self.letters = letters

        def raw(token: str) -> bytes:
            if self.suffix and token.endswith(self.suffix):
                return bytes(map(letters.__getitem__, token[: -len(self.suffix)])) + WORD_END
            return bytes(map(letters.__getitem__, token))

        vocab = model["vocab"]
        self.allowed = bytearray(65536)
        for token in vocab:
            b = raw(token)
            for x, y in zip(b, b[1:]):
                self.allowed[x << 8 | y] = 1
        ranks, ids = {bytes([i]): i for i in range(256)}, [0] * 256
        for token in sorted((t for t in vocab if len(raw(t)) == 1), key=vocab.get):
            ids[raw(token)[0]] = vocab[token]
        if self.suffix:
            for i in range(256):  # a last byte and its mark are one symbol from the start
                single = bytes([i]) + WORD_END
                name = next((t for t in (chr(c) + self.suffix for c in (next(ord(k) for k, v in letters.items() if v == i),)) if t in vocab), None)
                if name is not None:
                    ranks[single] = len(ids)
                    ids.append(vocab[name])
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            joined = raw(a + b)
            if joined not in ranks:
                ranks[joined] = len(ids)
                ids.append(vocab[a + b])
        self.ids = np.array(ids, np.uint32)
        self.id_bytes = [i.tobytes() for i in self.ids]
        self.core = tiktoken.Encoding("fragments", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = {t[:2] for t in self.special}
        names = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), "")
        names |= {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names[i] for i in sorted(names)]
        if not self.suffix:
            self.whole = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.spaced = np.zeros(len(ids), bool)
            self.spaced[[r for b, r in ranks.items() if b[:1] == b" "]] = True
            self.after_space: dict[str, bytes] = {}
        self.fragment = _Memo(self._fragment)
        self.word = _Memo(self._word)
        self.chunk = _Memo(lambda c: b"".join([self.word[w] for w in self.find(c)]))
        self.odd_chunk = _Memo(self._odd_chunk)

    def _fragment(self, data: bytes) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.core._encode_single_piece(data)))

    def fragments(self, word: bytes) -> list[bytes]:
        """``word`` (with its end mark, if the vocabulary has one) cut at every pair that no token holds."""
        allowed, out, at = self.allowed, [], 0
        for i in range(1, len(word)):
            if not allowed[word[i - 1] << 8 | word[i]]:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def _word(self, word: str) -> bytes:
        data = word.encode() + self.end
        return b"".join([self.fragment[f] for f in self.fragments(data)])

    def _odd_chunk(self, chunk: str) -> bytes:
        out = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk):
            out += [self.fragment[f] for f in self.fragments(bytes(map(self.letters.__getitem__, piece)) + self.end)]
        return b"".join(out)

    def _plain_part(self, part: str) -> bytes:
        if self.suffix:
            if not _PLAIN.search(part):
                return b"".join([self.chunk[c] for c in part.lower().split()])
            normal = self.library.normalizer.normalize_str(part)
            return b"".join([self.odd_chunk[c] for c in normal.split(" ") if c])
        memo = self.odd_chunk if _PLAIN.search(part) else self.chunk
        pieces = part.split(" ")
        if len(pieces) == 1 or not (_NO_CUT.search(part) or part[0] == " "):
            return b"".join([memo[pieces[0]], *[memo[" " + p] for p in pieces[1:]]]) if part else b""
        whole, held = [], pieces[0]
        for p in pieces[1:]:  # no cut behind white space
            if not held or held[-1].isspace():
                held += " " + p
            else:
                whole.append(held)
                held = " " + p
        return b"".join([memo[c] for c in [*whole, held]])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null or empty."""
        if not text:
            return b""
        if not any(m in text for m in self.marks):
            return self._plain_part(text)
        parts = self.cut_special.split(text)
        return b"".join([np.uint32(self.special[p]).tobytes() if i % 2 else self._plain_part(p) for i, p in enumerate(parts) if p])

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """:meth:`encode` of each text. Where spaces belong to what follows, chunks that no memo holds are encoded in one go:
        a space is a boundary, so each token that starts with one starts a chunk."""
        if self.suffix:
            return [self.encode(t) for t in texts]
        out: list[bytes | None] = [None] * len(texts)
        split, known = {}, self.after_space
        if len(known) >= 4 * MEMO:
            known.clear()
        for i, t in enumerate(texts):
            if not t or t[0] == " " or t[-1].isspace() or any(m in t for m in self.marks) or _PLAIN.search(t) or _NO_CUT.search(t):
                out[i] = self.encode(t)
            else:
                split[i] = t.split(" ")
        new = list({p for s in split.values() for p in s[1:] if p not in known})
        if new:
            ids = self.whole.encode_to_numpy(" " + " ".join(new))
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(new):
                data, at = self.ids[ids].tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                known.update(zip(new, [data[a:b] for a, b in zip(at, at[1:])]))
            else:
                known.update((p, self.chunk[" " + p]) for p in new)
        get = known.__getitem__
        for i, s in split.items():
            out[i] = b"".join([self.chunk[s[0]], *map(get, s[1:])])
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        tokens = list(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.library.decoder is None:
            return " ".join(tokens)
        return self.library.decoder.decode(tokens)


def engine(spec: str) -> ForcedBoundaryBpe:
    """The worker's engine for a tokenizer."""
    return hold("bpe", zlib.crc32(spec.encode()), lambda: ForcedBoundaryBpe(spec))


def load_spec(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast: a published vocabulary, a few megabytes whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def small_batches(batches, most_bytes: int = 4_000_000, column: int = -1):
    """Slices of Arrow batches with no more than about ``most_bytes`` in a text or binary column, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
        ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release_memory()  # workers wait for their next task with what they have


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``: each whole text's ids as little-endian unsigned 32-bit integers in a binary value.

    With ``decoded_col``, the ids are decoded again, in the same pass, into that column. Narrow: no shuffle, memory for a few
    megabytes of text and the memos. Null and empty texts have no ids. All columns are kept; columns with these names are replaced.
    """
    spec = load_spec(docs.sparkSession, tokenizer_path)
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in docs.columns if c not in new]

    def run(batches):
        e = engine(spec.value)
        for b in small_batches(batches):
            ids = e.encode_many(b.column(b.num_columns - 1).to_pylist())
            cols = [*b.columns[:-1], pa.array(ids, pa.binary())]
            if decoded_col:
                cols.append(pa.array([e.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *new])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(b"").alias(ids_col), *([F.lit("").alias(decoded_col)] if decoded_col else [])).schema
    return rows.mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded_col``, the text of the ids in ``ids_col`` (binary as in :func:`bpe_encode`, null: none)."""
    spec = load_spec(rows.sparkSession, tokenizer_path)

    def run(column: pa.Array) -> pa.Array:
        e = engine(spec.value)
        return pa.array([e.decode(i or b"") for i in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return rows.withColumn(decoded_col, F.arrow_udf(run, "string")(F.col(ids_col)))
