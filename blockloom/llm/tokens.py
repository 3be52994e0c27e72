"""Encoding whole texts with a public tokenizer, piece by piece: a text is cut only where the tokenizer's own rules
always cut, and what a piece encodes to is remembered, since words come back. Ids are little-endian unsigned 32-bit."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by one Python worker before it forgets the rarer ones.
MAX_CACHED = 500_000
#: Pieces encoded as one text, and marks that are neither letters nor digits to anybody.
_WORDS = 1000
_MARKS = ',.!?;:$&%#*|'
#: A single space before a character that is white space to nobody.
_BEFORE_WORD = re.compile(" (?=[^\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff])")
_NO_WORD = re.compile(_BEFORE_WORD.pattern.replace("(?=", "(?!"))
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers pieces as they are looked up; `new` gets those seen for the first time."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of start[k] ... start[k] + size[k] - 1, one range after the other."""
    after = np.cumsum(size)
    return np.repeat(start - after + size, size) + np.arange(after[-1] if len(after) else 0)


class Encoder:
    """`spaces`: "dropped" for a tokenizer that throws white space away (any run of ASCII white space parts pieces), or
    "kept" for a byte-level one whose words take the space before them (a piece starts at a space before a word). A piece
    of the second kind is written without that space; the text's first piece, which has none, with a space in front."""

    def __init__(self, file: str, spaces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(file)
        self.of.encode_special_tokens = True  # in a piece, which may be lower-cased; encode() cuts texts at them before
        added = self.of.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or (t.normalized and self.of.normalizer) for t in added.values()):
            raise ValueError(f"{file}: an added token that is not found by its plain string")
        self.added = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")  # leftmost, then longest
        self.dropped = spaces == "dropped"
        self.edge = np.zeros(self.of.get_vocab_size(), bool)  # tokens that end (dropped) or start (kept) a plain word
        for token, i in self.of.get_vocab().items():
            self.edge[i] = token.endswith("</w>") if self.dropped else token.startswith("\u0120")
        self._forget(np.zeros(0, np.int64))

    def _forget(self, keep: np.ndarray) -> None:
        """Start anew with the pieces numbered `keep`: ids of piece k are flat[start[k] : start[k] + size[k]]."""
        names, self.numbers = np.array(list(getattr(self, "numbers", ())), object)[keep].tolist(), _Numbers()
        for name in names:
            self.numbers[name] = len(self.numbers)
        size = self.size[keep] if len(keep) else np.zeros(0, np.int64)
        flat = [self.flat[_ranges(self.start[keep], size)]] if len(keep) else []
        self.flat, self.start, self.size, self.uses = np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 3
        self._add(np.cumsum(size) - size, size, flat)

    def _add(self, start: np.ndarray, size: np.ndarray, data: list[np.ndarray]) -> None:
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, *data])

    def pieces(self, text: str) -> list[str]:
        if self.dropped:
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z, as the tokenizer will
            for c in "\t\n\x0b\x0c\r":
                if c in text:
                    text = text.replace(c, " ")
            return list(filter(None, text.split(" ")))
        out = _BEFORE_WORD.split(text) if _NO_WORD.search(text) else text.split(" ")
        out[0] = " " + out[0]
        return out

    def _edges(self, piece: str) -> int:
        """How many edge tokens a piece must have when it stands among others; 0: not known, it is encoded alone."""
        if not self.dropped:
            return 0 if " " in piece else 1  # the space before it begins its first token, and it holds no other
        word = piece.rstrip(_MARKS)
        if word.isalpha():
            return 1 + (len(word) < len(piece))  # letters are one word to the tokenizer, the marks behind them another
        return int(not word)

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces, many in one text, which is parted again at its edge tokens. A text whose edges are not as
        many as they must be is encoded piece by piece."""
        size, data = np.zeros(len(new), np.int64), {}
        edges = np.fromiter(map(self._edges, new), np.int64, len(new))
        known = np.flatnonzero(edges)
        alone = np.flatnonzero(edges == 0).tolist()
        groups = [known[i : i + _WORDS] for i in range(0, len(known), _WORDS)]
        texts = [("" if self.dropped else " ") + " ".join([new[k] for k in g.tolist()]) for g in groups]
        for g, e in zip(groups, self.of.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.edge[ids])
            last = np.cumsum(edges[g])
            if len(at) != last[-1] or not (self.edge[ids[-1]] if self.dropped else self.edge[ids[0]]):
                alone += g.tolist()
                continue
            size[g] = np.diff(at[last - 1] + 1, prepend=0) if self.dropped else np.diff(at, append=len(ids))
            data[int(g[0])] = (g, ids)
        pieces = [new[k] for k in alone]
        if not self.dropped:
            pieces = [p[1:] if p[:1] == " " else " " + p for p in pieces]
        own = [np.array(e.ids, np.uint32) for e in self.of.encode_batch_fast(pieces, add_special_tokens=False)]
        size[alone] = [len(x) for x in own]
        order = np.concatenate([*[g for g, _ in data.values()], np.array(alone, np.int64)])
        start = np.empty(len(new), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self._add(start, size, [*[ids for _, ids in data.values()], *own])

    def encode(self, texts: list[str]) -> list[bytes]:
        """An added token's string is that token, as the library has it by default; the text on either side of it is encoded
        as a text of its own."""
        cut = [self.cut.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        done = iter(self._plain([x for c in cut for x in c[::2]]))
        return [b"".join([self.added[x] if k % 2 else next(done) for k, x in enumerate(c)]) for c in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > MAX_CACHED or len(self.flat) > 20 * MAX_CACHED:  # what came back since the last time stays
            often = np.argsort(-self.uses, kind="stable")[: MAX_CACHED // 2]
            self._forget(np.sort(often[self.uses[often] > 1]))
        cut = [self.pieces(t) for t in texts]
        ends = np.cumsum([len(c) for c in cut])
        k = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64, ends[-1])
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new.clear()
        self.uses += np.bincount(k, minlength=len(self.uses))
        size = self.size[k]
        after = np.cumsum(size)
        ids = self.flat[_ranges(self.start[k], size)].astype("<u4").tobytes()
        bounds = np.append(0, after)[np.append(0, ends)] * 4
        return [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def encoder(file: str, spaces: str) -> Encoder:
    """The one encoder of this Python process for a file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file, spaces)
    return _ENCODERS[file]


def slices(rows: int, lengths: list[int], most: int = 8_000_000):
    """Ranges of rows with about `most` characters each, so that a batch of long texts is never held encoded at once."""
    start = total = 0
    for i in range(rows):
        total += lengths[i]
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < rows:
        yield start, rows


def parts(batch: pa.RecordBatch, text: str = "text", most: int = 2_000_000):
    """The batch in slices of about `most` bytes of text, so that few texts are Python strings at a time."""
    for a, b in slices(batch.num_rows, pc.binary_length(batch.column(text)).to_pylist(), most):
        yield batch.slice(a, b - a)
