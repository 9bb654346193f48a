"""Exact token ids by the tokenizers library, one call per distinct chunk instead of one per text.

A byte-level BPE cuts a text into pieces before it merges bytes, and a single space or line end
between two characters that are no white space always begins a piece. Texts are therefore cut there,
and the library's ids of each chunk are kept while the worker lives, up to a bound. Texts that hold
an added token's string, or other runs of white space, go to the library in larger parts.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks that one worker keeps, about 200 bytes each; what comes later is kept for its batch alone.
KEPT_CHUNKS = 600_000
#: Chunks that go to the library as one text.
JOINED = 2_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes | None] = {}
        #: by id: does the token begin a chunk, that is with a space or a line end
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> list[str]:
        """Adds the chunks to those kept; returns those that are beyond the bound."""
        new = [c for c in chunks if c not in self.kept]
        plain, other = [], []
        for c in new:
            body = c[1:] if c[:1] == "\n" else c
            if not body or body[0].isspace() or body[-1].isspace():
                self.kept[c] = None  # not a chunk between two safe cuts
            else:
                (plain if len(body.split()) == 1 else other).append(c)
        whole = lambda c: c if c[0] == "\n" else " " + c
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(map(whole, part))], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(part):  # never seen; a vocabulary with other marks of white space
                self.kept.update(zip(part, self._ids(list(map(whole, part)))))
                continue
            flat, cuts = ids.tobytes(), (np.append(at, len(ids)) * 4).tolist()
            self.kept.update((c, flat[x:y]) for c, x, y in zip(part, cuts, cuts[1:]))
        self.kept.update(zip(other, self._ids(list(map(whole, other)))))
        return new[max(0, KEPT_CHUNKS - len(self.kept) + len(new)) :]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Give batches of some megabytes: chunks are learnt for all at once."""
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        chunks: set[str] = set()
        for c in cut:
            chunks.update(c[1:])
        late = self._learn(chunks)
        firsts = dict(zip(names := list({c[0] for c in cut}), self._ids(names)))
        out: list[bytes] = []
        for text, c in zip(texts, cut):
            try:
                if any(a in text for a in self.added):
                    raise TypeError
                # a first chunk that ends in white space is no safe cut
                if len(c) > 1 and (not c[0] or c[0][-1].isspace()):
                    raise TypeError
                out.append(firsts[c[0]] + b"".join(map(self.kept.__getitem__, c[1:])))
            except TypeError:
                out.append(self._apart(text))
        for c in late:
            del self.kept[c]
        return out

    def _apart(self, text: str) -> bytes:
        """A text whose single spaces are not all safe cuts."""
        if any(a in text for a in self.added):
            return self._ids([text])[0]
        first, *rest = _CUT.split(text)
        return b"".join(self._ids([first, *(" " + c for c in rest)]))


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def batches(texts: list[str], most: int = 4_000_000):
    """Slices of ``texts`` of about ``most`` characters, at least one text each."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
