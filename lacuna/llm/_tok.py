"""Exact, fast encoders for the two tokenizer files, built from reuse of words.

A byte-pair encoder treats each pre-token (a word, a number, a run of marks) on its own, so the
ids of a text are the ids of its words in order, wherever a cut between words is also a cut
between pre-tokens.  Each encoder asks the library only about words that it has not met yet;
what it learnt stays in a bounded table in the Python worker.  Texts outside a plain set of
characters, or with spacing where the cuts would differ, go to the library whole.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

from ._spark import kept

#: Characters for which Python and the library agree on letters, numbers, white space and case.
_PLAIN = re.compile(r"[\t-\r -\x7e\xa0-ɏ]*")
#: White space before a space: the byte-level pattern would join the two.
_JOINED = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\xa0 ")
#: The byte-level pattern as the library states it (fixed value).
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in either generation of the table; when the young one is full, it becomes the old one, and
#: what is used again moves back.  Longer words than MEMO_CHARS are not kept, so the table is bounded in bytes, too.
MEMO_WORDS, MEMO_CHARS = 250_000, 48
#: Characters of a text that are encoded together; longer texts are cut before a space between two other characters, which
#: both files' patterns cut before as well.
PIECE_CHARS = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Memo(dict):
    """The young generation; words of the old one move in when they are used."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word):
        got = self[word] = self.old[word]
        return got

    def unknown(self, words: list[str]) -> list[str]:
        old = self.old
        new = [w for w in set(words) if w not in self and w not in old]
        if len(self) + len(new) > MEMO_WORDS:
            self.old = dict(self)
            self.clear()
            old = self.old
            new = [w for w in set(words) if w not in old]
        return new


def load(path: str):
    """The library's own tokenizer, without truncation or padding."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def plain(text: str) -> bool:
    """Whether a text may be cut at white space (no special token's text, no odd characters)."""
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


def cuts(text: str):
    """A long text in pieces that can be encoded singly."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        found = _CUT.search(text, at + PIECE_CHARS)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class _Encoder:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.memo = _Memo()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.memo.update((w, array("I", x.ids).tobytes()) for w, x in zip(new, got, strict=True))

    def learn_together(self, new: list[str], mark: str) -> None:
        """The same in one call: words joined by a mark, a pre-token of one id that none of them contains."""
        plain_, rest = [w for w in new if mark not in w], [w for w in new if mark in w]
        sign = self.tokenizer.encode(mark, add_special_tokens=False).ids
        ids = np.array(self.tokenizer.encode_batch_fast([f" {mark} ".join(plain_)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == sign[0])
        if len(sign) != 1 or len(cuts) != len(plain_) - 1:
            plain_, rest = [], new
        else:
            data = ids.tobytes()
            starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)]
            self.memo.update((w, data[a:b]) for w, a, b in zip(plain_, starts, ends, strict=True))
        if rest:
            _Encoder.learn(self, rest)

    def words(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit."""
        return b"".join(map(self._encode, cuts(text))) if len(text) > PIECE_CHARS else self._encode(text)

    def _encode(self, text: str) -> bytes:
        words = self.words(text)
        if words is None:
            return self.whole(text)
        new = self.memo.unknown(words)
        if new:
            self.learn(new)
        out = b"".join(map(self.memo.__getitem__, words))
        for w in new:
            if len(w) > MEMO_CHARS:
                self.memo.pop(w, None)
                self.memo.pop(w[:-1], None)
        return out


class ByteEncoder(_Encoder):
    """Ids of the byte-level BPE.  ``ranks``: the same vocabulary as ranks, for the faster library."""

    def __init__(self, path: str, ranks: str):
        import tiktoken

        super().__init__(path)
        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("own", pat_str=_BYTE_PATTERN, mergeable_ranks=table, special_tokens={})

    def words(self, text: str) -> list[str] | None:
        if not plain(text) or any(x in text for x in _JOINED):
            return None
        return text.replace(" ", "\0 ").split("\0")

    def whole(self, text: str) -> bytes:
        if plain(text):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        return super().whole(text)

    def learn(self, new: list[str]) -> None:
        one = self.fast.encode_ordinary
        self.memo.update((w, array("I", one(w)).tobytes()) for w in new)


class WordEncoder(_Encoder):
    """Ids of the lower-casing BPE that drops white space: every cut at white space is a cut."""

    def words(self, text: str) -> list[str] | None:
        return text.lower().split() if plain(text) else None

    def learn(self, new: list[str]) -> None:
        # one mark after a letter or number is a pre-token of its own: the word before it may be known
        memo = self.memo
        bare = [w[:-1] if len(w) > 1 and w[-1] in ",." and w[-2].isalnum() else w for w in new]
        need = {x for w, b in zip(new, bare, strict=True) for x in ((w,) if w is b else (b, w[-1])) if x not in memo and x not in memo.old}
        if need:
            self.learn_together(list(need), "|")
        memo.update((w, memo[b] + memo[w[-1]]) for w, b in zip(new, bare, strict=True) if w is not b)


def encoder(kind, *paths: str):
    """One encoder for a kind and file in a Python worker, kept between the tasks of an operator."""
    return kept((kind.__name__, paths), lambda: kind(*paths))
