"""Operator 8, exact token counts at every prefix by dynamic programming.

A sentencepiece BPE never merges across a boundary from another character to a space (the vocabulary
is checked for that), so a text is a row of segments, each some spaces and what follows. Within one,
the encoding of a prefix ends with one token; the rest of it is the encoding of a shorter prefix. So
count(i) = count(i - len(t)) + 1, where t is the token that ends at i and that stands behind the last
token of the shorter prefix as the library would have it, which is asked once per pair of tokens. The
last count of each segment is held against the library's own; where they differ, the library counts
each prefix of the segment. Segments that were met before are not counted again in a worker.

The table has one row per document with the change of the count at each code point, a signed byte
(a code point that is no piece costs up to four byte tokens, so changes are small). Budgets and
truncations are then answered from the table: ``tokens_at`` and ``longest_within``.

Nulls and the like: a null text is empty and has 0 tokens; repeated rows are rows of their own; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged
from tidemark.llm.tokenize import batches

#: Segments that one worker keeps, about 200 bytes each.
KEPT_SEGMENTS = 600_000

_SPACE = "▁"
_LINES = re.compile(r"\n|[^\n]+")
_CUT = re.compile(r"(?<=[^ ])(?= )")
_COUNTERS: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Changes of the token count at each code point of whole texts."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.pieces = {i: lib.id_to_piece(i) for i in ids}
        self.length = {i: len(p) for i, p in self.pieces.items()}
        self.single = {p for p in self.pieces.values() if len(p) == 1}
        #: a space only begins a piece, and a line end is in none, so texts may be cut at both
        self.separable = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in self.pieces.values())
        self.ending = ahocorasick.Automaton()
        for i, p in self.pieces.items():
            if self._pieces_of(p) == [i]:  # others are never made
                self.ending.add_word(p, i)
        self.ending.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def _pieces_of(self, text: str) -> list[int]:
        """The library's ids of a part of a text, without the dummy space that it puts in front."""
        if text == _SPACE:
            return [self.library.piece_to_id(text)]  # the library adds no dummy space to an empty text
        if text[0] == _SPACE:
            return self.library.encode(text[1:])
        got = self.library.encode("\n" + text)  # the line end's byte piece keeps the dummy space apart
        return got[2:]

    def _stands(self, last: int, token: int) -> bool:
        """Does the library keep ``last`` and ``token`` apart where they meet?"""
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        ok = self.pairs[last << 20 | token] = self._pieces_of(self.pieces[last] + self.pieces[token]) == [last, token]
        return ok

    def _programme(self, text: str) -> tuple[list[int], list[int]]:
        """Counts of all prefixes of ``text``, the empty one first, and the ends where no piece fits."""
        counts, last, failed = [0] * (len(text) + 1), [-1] * (len(text) + 1), []
        length, pairs, done = self.length, self.pairs, 0

        def alone(upto: int) -> None:  # code points that no piece ends at are byte pieces
            for k in range(done, upto):
                c = text[k]
                counts[k + 1] = counts[k] + len(c.encode("utf-8", "surrogatepass"))
                if c in self.single:
                    failed.append(k + 1)

        for end, token in self.ending.iter(text):
            if end < done:
                continue
            if end > done:
                alone(end)
                done = end
            at = end + 1 - length[token]
            before = last[at]
            if before >= 0:
                ok = pairs.get(before << 20 | token)
                if not (self._stands(before, token) if ok is None else ok):
                    continue
            done = end + 1
            counts[done], last[done] = counts[at] + 1, token
        alone(len(text))
        return counts, failed

    def _asked(self, segment: str) -> list[int]:
        """By the library, prefix by prefix."""
        return np.diff([0, *(len(self._pieces_of(segment[:i])) for i in range(1, len(segment) + 1))]).tolist()

    def _learn(self, segments: set[str]) -> list[str]:
        new = [s for s in segments if s not in self.kept]
        totals = self.library.encode([s[1:] if s[:1] == _SPACE else "\n" + s for s in new], num_threads=1)
        text = "\n".join(new)
        counts, failed = self._programme(text)
        changes = np.diff(np.array(counts, dtype=np.int64)).astype(np.int8).tobytes()
        ends = np.cumsum([len(s) + 1 for s in new]).tolist()
        bad = set(np.searchsorted(ends, failed).tolist())
        begin = 0
        for i, (s, ids, end) in enumerate(zip(new, totals, ends)):
            d = changes[begin : end - 1]
            total = max(1, len(ids)) if s[:1] == _SPACE else len(ids) - 2
            if i in bad or counts[end - 1] - counts[begin] != total:
                d = np.array(self._asked(s), dtype=np.int8).tobytes()
            self.kept[s] = d
            begin = end
        return new[max(0, KEPT_SEGMENTS - len(self.kept) + len(new)) :]

    def changes(self, texts: list[str]) -> list[bytes]:
        """One signed byte per code point and text; a text's first byte includes the dummy space."""
        if not self.separable:
            raise ValueError("this vocabulary merges across spaces or line ends")
        cut: list[list[str]] = []
        for t in texts:
            t = t.replace(_SPACE, " ")
            if not t:
                cut.append([])
            else:  # "\n" is a segment; what follows it has no dummy space
                parts = _CUT.split(" " + t) if "  " in t or t[0] == " " or t[-1] == " " else None
                own = [x.replace(" ", _SPACE) for x in parts] if parts else [_SPACE + x for x in t.split(" ")]
                cut.append([y for x in own for y in _LINES.findall(x)] if "\n" in t else own)
        late = self._learn({s for c in cut for s in c})
        out = []
        for c in cut:
            d = b"".join(map(self.kept.__getitem__, c))
            if d:  # the dummy space is no code point of the text: its change goes to the first one
                d = np.frombuffer(d[:2], dtype=np.int8).sum(dtype=np.int8).tobytes() + d[2:]
            out.append(d)
        for s in late:
            del self.kept[s]
        return out


def counter(path: str) -> PrefixCounter:
    """The worker's counter of this model file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, changes (binary: a signed byte per code point)."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = counter(model)
        for part in parts:
            keys, texts = part.column(0), part.column(1).to_pylist()
            for a, b in batches(texts, 2_000_000):
                own = lib.changes(texts[a:b])
                sums = [int(np.frombuffer(d, dtype=np.int8).sum(dtype=np.int64)) for d in own]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "changes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, changes binary")
    return staged(out, "prefix-counts")


@F.pandas_udf(T.LongType())
def _at(changes, prefix):
    import pandas as pd

    return pd.Series([int(np.frombuffer(c, dtype=np.int8)[: max(0, k)].sum(dtype=np.int64)) for c, k in zip(changes, prefix)])


@F.pandas_udf(T.LongType())
def _within(changes, budget):
    import pandas as pd

    def longest(c: bytes, most: int) -> int:
        fits = np.flatnonzero(np.cumsum(np.frombuffer(c, dtype=np.int8), dtype=np.int64) <= most)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([longest(c, k) for c, k in zip(changes, budget)])


def tokens_at(prefix: Column | int) -> Column:
    """Tokens of the first ``prefix`` code points, from the table alone."""
    return _at("changes", prefix if isinstance(prefix, Column) else F.lit(prefix))


def longest_within(budget: Column | int) -> Column:
    """The longest prefix, in code points, of at most ``budget`` tokens, from the table alone."""
    return _within("changes", budget if isinstance(budget, Column) else F.lit(budget))


def counts(table: DataFrame, limit: int = 4096) -> DataFrame:
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
