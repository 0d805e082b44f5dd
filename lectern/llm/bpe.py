"""BPE encoding and decoding by tree concatenation.

A text is cut into pre-tokens by the tokenizer's own pattern; a pre-token's ids never depend on its neighbours. What stays
unsplit and is long is halved again and again: the halves are encoded by themselves (texts over SEGMENT characters as rows of
their own, in parallel tasks), then a window around each join is encoded anew and grows until its first and last token
are the ones that the two sides already have. Adjacent tokens that are valid in pairs make a valid encoding, so the
joined ids are exactly those of the whole.

Only word BPE files are taken whose normaliser is NFC, white space to blanks, lower case, whose pre-tokens hold no white
space, and whose words end in a marker. Runs without white space are normalised, cut and encoded by themselves, in any script; a special token's string is
cut out before. Only a run with a character that this Python's Unicode tables don't know yet (category Cn) is left to the tokenizers library.

null text counts as empty (no ids); an empty text gives no ids. Further columns of the input stay.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keep_only

#: Characters of a text from which its leaves become rows of their own.
SEGMENT = 65_536
#: Bytes of a pre-token from which it is halved, and of a half that is halved no more.
LONG, LEAF = 384, 64
#: Words that a worker remembers, twice.
REMEMBERED = 120_000

#: The file's pre-token pattern.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Separators that str.split takes and the file doesn't.
_NO_SPACE = regex.compile(r"[\x1c-\x1f]")
_RUN = regex.compile(r"[^\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def normal(text: str) -> str:
    """NFC and lower case, each character by itself (str.lower looks at what stands around a capital sigma)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def unknown(text: str) -> bool:
    """Whether some character is unassigned in this Python's Unicode tables."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that NFC may put together with the one before: second parts of decompositions, and Hangul vowels and finals."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(x[1], 16)) for x in parts if len(x) == 2 and x[0][0] != "<") | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def runs(text: str) -> list[str]:
    return _RUN.findall(text) if _NO_SPACE.search(text) else text.split()


def _byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[str, dict[bytes, int]]:
    """The file's JSON, and its tokens as bytes (a word's end is one blank) with their ids.

    The library merges listed pairs only; a rank table merges whatever adjacent pair spells a token. Both agree if every
    token is what its own symbols merge to; tokens that are not can never arise and are left out.
    """
    said = open(path, encoding="utf-8").read()
    model = json.loads(said)["model"]
    mark, symbols = model["end_of_word_suffix"], _byte_symbols()
    vocab, merges = model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(merges)}

    def split(token: str) -> list[str]:
        word = token.removesuffix(mark) if token != mark else token
        parts = list(word)
        return parts if len(word) == len(token) else [*parts[:-1], parts[-1] + mark]

    def reached(token: str) -> bool:
        parts = split(token)
        while len(parts) > 1:
            i = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
            if (parts[i], parts[i + 1]) not in rank:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    base = [t for t in vocab if len(split(t)) == 1 and all(c in symbols for c in t.removesuffix(mark))]
    ids = {}
    order = [t for t in base] + [a + b for a, b in merges]
    if [vocab[t] for t in order] != sorted(vocab[t] for t in order):
        raise ValueError("ids must follow the order of the merges")
    for t in order:
        if reached(t):
            word = t.removesuffix(mark)
            ids[bytes(symbols[c] for c in word) + b" " * (len(word) != len(t))] = vocab[t]
    return said, ids


class _Words(dict):
    """The ids of words, made where they are missing. Of the words before the last REMEMBERED ones, as many stay: frequent ones are not made again and again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= 64:  # long words are rare and not kept
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes in one process."""

    def __init__(self, said: str, ids: dict[bytes, int]):
        import tiktoken

        self.said, self.rank = said, ids
        self.spelled = {i: b for b, i in ids.items()}
        self.whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ids, special_tokens={}).encode_ordinary
        config = json.loads(said)
        size = max([*config["model"]["vocab"].values(), *(t["id"] for t in config["added_tokens"])]) + 1
        self.tokens = [""] * size
        for token, i in [*config["model"]["vocab"].items(), *((t["content"], t["id"]) for t in config["added_tokens"])]:
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = _Words(self.word)

    @functools.cached_property
    def library(self):
        """The tokenizers library's own tokenizer, for characters that are newer than Python's tables."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self.said)
        own.no_truncation()
        own.no_padding()
        return own

    def merged(self, b: bytes) -> list[int]:
        """The ids of bytes by merges of least rank, alone; a blank at the end is the marker."""
        if len(b) > LEAF:
            try:
                return self.whole(b.decode())
            except UnicodeDecodeError:  # the bytes begin or end within a character
                pass
        parts = [b[i : i + 1] for i in range(len(b))]
        if b[-1:] == b" ":
            parts[-2:] = [b[-2:]]
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(r, i) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i] if parts[i] else n
            if j >= n or rank.get(parts[i] + parts[j]) != r:
                continue  # one of the two has been merged since
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(todo, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get(parts[h] + parts[i])) is not None:
                heapq.heappush(todo, (r, h))
        return [rank[x] for x in parts if x]

    def piece(self, text: str) -> list[int]:
        """The ids of a pre-token."""
        b = text.encode() + b" "
        return self.whole(text + " ") if len(b) <= LONG else self._halved(b)

    def _halved(self, b: bytes) -> list[int]:
        if len(b) <= LEAF:
            return self.merged(b)
        half = len(b) // 2
        return self.joined(self._halved(b[:half]), self._halved(b[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two adjacent parts' bytes together, from the ids of each."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            middle = self.merged(b"".join(map(self.spelled.__getitem__, a + b)))
            if (k >= len(left) or middle[0] == a[0]) and (k >= len(right) or middle[-1] == b[-1]):
                return left[:-k] + middle + right[k:]
            k *= 2

    def items(self, run: str) -> list[str | int]:
        """Pre-tokens of a run as it stands in the text, and ids of special tokens (or of what only the library knows)."""
        out: list[str | int] = []
        for part in self.cut.split(run) if self.cut else [run]:
            if part in self.special:
                out.append(self.special[part])
            elif unknown(part):
                out += self.library.encode(part, add_special_tokens=False).ids
            else:
                out += _PIECE.findall(normal(part))
        return out

    def encoded(self, items: list[str | int]) -> array:
        return array("I", [i for x in items for i in ((x,) if isinstance(x, int) else self.piece(x))])

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        if any(s in text for s in self.special) or unknown(text):
            return b"".join(self.encoded(self.items(r)).tobytes() for r in runs(text))
        words = runs(normal(text))
        return b"".join(map(self.words.__getitem__, words))

    def word(self, word: str) -> bytes:
        """The ids of a normalised run; its pre-tokens are remembered as words of their own."""
        if len(word) <= 64 and word.isalpha() and max(word) < "\u0250":  # Latin letters are one pre-token
            return array("I", self.whole(word + " ")).tobytes()
        pieces = _PIECE.findall(word)
        return self.encoded(pieces).tobytes() if len(pieces) < 2 else b"".join(map(self.words.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives without a decoder: the tokens with blanks between them."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))

    def _apart(self, tail: str, head: str) -> bool:
        """Whether what stands on either side of a cut is normalised, and searched for special tokens, by itself."""
        if unicodedata.combining(head[0]) or head[0] in _seconds() or unknown(tail) or unknown(head):
            return False
        return not any(s in tail[1 - len(s) :] + head[: len(s) - 1] for s in self.special)

    def join_texts(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """Two adjacent segments of a text with their ids, as one.

        Only the run that the cut goes through can change. A window of k pre-tokens on each side is cut and encoded anew, and grows until its
        outermost pre-tokens are those of the two sides. A cut through a character's marks or a special token takes the run anew.
        """
        (lt, li), (rt, ri) = left, right
        tail, head = lt[_last_run(lt) :], rt[: _first_run(rt)]
        if not tail or not head:
            return lt + rt, li + ri
        lp, rp = self.items(tail), self.items(head)
        size = lambda items: 4 * len(self.encoded(items))
        if not self._apart(tail, head):
            return lt + rt, li[: len(li) - size(lp)] + self.encoded(self.items(tail + head)).tobytes() + ri[size(rp) :]
        # special tokens bound what a window may hold
        lp = lp[next((i + 1 for i in range(len(lp) - 1, -1, -1) if isinstance(lp[i], int)), 0) :]
        rp = rp[: next((i for i, x in enumerate(rp) if isinstance(x, int)), len(rp))]
        k = 2
        while True:
            a, b = lp[-k:], rp[:k]
            middle = _PIECE.findall("".join(a + b))
            if (k >= len(lp) or middle[0] == a[0]) and (k >= len(rp) or middle[-1] == b[-1]):
                return lt + rt, li[: len(li) - size(a)] + self.encoded(middle).tobytes() + ri[size(b) :]
            k *= 2

    def tree(self, parts: list[tuple[str, bytes]]) -> bytes:
        while len(parts) > 1:
            parts = [self.join_texts(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else b""


def _first_run(text: str) -> int:
    """Where the run at the text's beginning ends."""
    found = _RUN.match(text)
    return found.end() if found else 0


def _last_run(text: str) -> int:
    """Where the run at the text's end begins."""
    k = 256
    while True:
        near = text[-k:]
        found = _RUN.findall(near)
        if not found or not near.endswith(found[-1]):
            return len(text)
        if len(found[-1]) < len(near) or k >= len(text):
            return len(text) - len(found[-1])
        k *= 4


_codecs: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """This worker's codec for a broadcast (JSON, ids); its words stay from batch to batch."""
    keep_only("bpe", _codecs.clear)
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(*shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast with its id; the file has a fixed size, so what is broadcast doesn't grow with the data."""

    def __init__(self, spark, path: str):
        self.sent = spark.sparkContext.broadcast(load(path))
        self.id = hashlib.sha1(path.encode()).hexdigest()

    @property
    def value(self):
        return self.sent.value


def shared_codec(spark, path: str) -> _Shared:
    return _Shared(spark, path)


def encode_with(df: DataFrame, path: str, make, schema: T.StructType, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Encodes df[text] and applies make(codec, rows, ids) -> pyarrow.Table to batches; rows is a table of the other columns.

    Short texts are encoded where they are read. Texts over `segment` characters are cut into segments that are rows of their
    own, encoded in parallel, and joined by one task per text. The other columns pass as Arrow arrays, untouched.
    """
    bounded_batches(df.sparkSession)
    shared = shared_codec(df.sparkSession, path)
    rest = [c for c in df.columns if c != text]
    kept = [f"c{i}" for i in range(len(rest))]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rest, kept, strict=True)], body.alias("body"))

    def table(x: pa.Table) -> pa.Table:
        return x.select(kept).rename_columns(rest)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for x in batches:
            yield from make(codec, table(pa.Table.from_batches([x])), [codec.ids(t) for t in x.column("body").to_pylist()]).to_batches()

    size = F.length("body")
    short = df.where(size <= segment).mapInArrow(whole, schema)
    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / segment).cast("int")), lambda i: F.substring("body", i * segment + 1, F.lit(segment)))
    # the number of a row is made before its segments are, or each segment would have its own
    long = df.where(size > segment).withColumn("row", F.monotonically_increasing_id())
    long = long.select(*kept, "row", F.posexplode(cut).alias("part", "body"))
    leaf = T.StructType([*long.schema.fields, T.StructField("ids", T.BinaryType())])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for x in batches:
            ids = pa.array([codec.ids(t) for t in x.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns, ids], names=leaf.names)

    def join(x: pa.Table) -> pa.Table:
        codec = codec_of(shared)
        x = x.sort_by("part")
        ids = codec.tree(list(zip(x.column("body").to_pylist(), x.column("ids").to_pylist(), strict=True)))
        return make(codec, table(x.slice(0, 1)), [ids])

    parts = long.repartition(F.xxhash64("row", "part")).mapInArrow(leaves, leaf)
    return short.union(parts.groupBy("row").applyInArrow(join, schema))


def listed(ids: list[bytes]) -> pa.Array:
    """ids as a column of lists of 32-bit integers."""
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(i) // 4 for i in ids])].astype(np.int32), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", segment: int = SEGMENT) -> DataFrame:
    """df without the text, with its ids as array<int> in `out` (a column of that name is replaced)."""
    df = df.drop(out) if out != text else df
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return encode_with(df, path, lambda _, rows, ids: rows.append_column(out, listed(ids)), schema, text, segment)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of df[ids] in `out`; null ids count as none, unknown ids as nothing, as with the library."""
    shared = shared_codec(df.sparkSession, path)

    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        codec = codec_of(shared)
        return pd.Series([" ".join(codec.tokens[i] for i in (v if v is not None else ()) if 0 <= i < len(codec.tokens)) for v in x])

    return df.withColumn(out, decoded(F.col(f"`{ids}`")))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])

    def make(codec: Codec, rows: pa.Table, ids: list[bytes]) -> pa.Table:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        rows = rows.append_column("n_tokens", pa.array([len(i) // 4 for i in ids], pa.int64()))
        return rows.append_column("ids_sha256", pa.array([sha(i) for i in ids], pa.string())).append_column("decoded_sha256", pa.array([sha(codec.decode(i).encode()) for i in ids], pa.string()))

    return encode_with(docs, path, make, schema)
