"""Ids of a byte-level tokenizer, looked up by stretches of text between spaces.

The tokenizers library gives the ids of every stretch (a space and what follows up to the next one); a worker keeps them, so a
stretch that comes again is not encoded again. The ids are those of the whole text: byte-level splitting never
crosses a space that is followed by something other than white space (a run of white space gives its last
character to what follows), looks back at nothing, and looks ahead only for the end of such a run; merges
stay inside what it splits. Texts with other white space after a space, a space at their end, an odd
character after a space, or the string of a token that the library would match first are encoded whole, and so are
all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain, islice

import numpy as np

#: Stretches kept by a worker (some 300 bytes each), and the longest that is kept.
KEPT, LONGEST = 1 << 19, 64
#: Characters encoded whole by one call.
AT_ONCE = 1 << 18
#: How byte-level vocabularies write a space.
SPACE = "Ġ"


class Numbers(dict):
    """Stretches' numbers; one that is new gets the next and is noted, or -1 where it must not be looked up."""

    def __init__(self, owner: ByteLevel, plain: bool):
        super().__init__()
        self.owner, self.plain, self.new = owner, plain, []

    def __missing__(self, key: str) -> int:
        k = -1
        if self.plain or key and unicodedata.category(key[0])[0] not in "ZC":
            k = self.owner.count
            self.owner.count += 1
            self.new.append((k, key))
        self[key] = k
        return k


class ByteLevel:
    """A tokenizer read from its file's text; literal: special tokens' strings are plain text."""

    def __init__(self, text: str, literal: bool = False, kept: int = KEPT):
        self.kept = kept
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.encode_special_tokens = literal
        shape = json.loads(text)
        split = shape.get("pre_tokenizer") or {}
        self.by_stretch = shape.get("normalizer") is None and shape["model"]["type"] == "BPE" and (split.get("type"), split.get("use_regex", True), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.marks = [x["content"] for x in shape.get("added_tokens", []) if not (literal and x["special"])]
        self.opens = np.zeros(max(self.library.get_vocab().values(), default=-1) + 1, bool)  # ids whose bytes begin with a space
        self.opens[[k for piece, k in self.library.get_vocab(with_added_tokens=False).items() if piece.startswith(SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.count = 0
        self.later, self.head = Numbers(self, False), Numbers(self, True)  # with and without a space before the key
        self.tokens, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            n, end = 0, at
            while end < len(texts) and (end == at or n + len(texts[end]) <= AT_ONCE):
                n += len(texts[end])
                end += 1
            out += [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def _learn(self) -> None:
        """Encodes new stretches, joined to long texts; a stretch begins at a token that begins with the space."""
        later, heads = self.later.new, self.head.new
        at, size = np.zeros(self.count, np.int64), np.zeros(self.count, np.int64)
        at[: len(self.at)], size[: len(self.size)] = self.at, self.size
        parts, end = [self.tokens], len(self.tokens)
        runs = [later[i : i + 4096] for i in range(0, len(later), 4096)]
        for run, ids in zip(runs, self._whole([" " + " ".join([key for _, key in run]) for run in runs]), strict=True):
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(run):
                raise AssertionError("a stretch does not begin with a space")
            which = np.array([k for k, _ in run])
            at[which], size[which] = end + starts, np.diff(starts, append=len(ids))
            parts.append(ids)
            end += len(ids)
        for (k, _), ids in zip(heads, self._whole([key for _, key in heads]), strict=True):
            at[k], size[k] = end, len(ids)
            parts.append(ids)
            end += len(ids)
        self.tokens, self.at, self.size = np.concatenate(parts), at, size
        for held in (self.later, self.head):
            for _, key in held.new:
                if len(key) > LONGEST:
                    del held[key]
            held.new = []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids (32-bit unsigned)."""
        if not self.by_stretch:
            return self._whole(texts)
        if self.count > self.kept or len(self.tokens) > 8 * self.kept:
            self._forget()
        split = [[""] if any(m in x for m in self.marks) else x.split(" ") for x in texts]
        n = np.array([len(x) for x in split], np.int64)
        begin = np.cumsum(n) - n
        number = np.empty(int(n.sum()), np.int64)
        first = np.zeros(len(number), bool)
        first[begin] = True
        number[first] = [self.head[x[0]] for x in split]
        number[~first] = np.fromiter(map(self.later.__getitem__, chain.from_iterable(islice(x, 1, None) for x in split)), np.int64, len(number) - len(split))
        self._learn()
        odd = {int(k) for k in np.unique(np.repeat(np.arange(len(texts)), n)[number < 0])} | {k for k, x in enumerate(texts) if any(m in x for m in self.marks)}
        number[number < 0] = 0
        size = self.size[number]
        total = np.cumsum(size)
        tokens = self.tokens[np.arange(total[-1] if len(total) else 0) + np.repeat(self.at[number] - total + size, size)]
        ends = np.append(total, 0)[begin + n - 1].tolist() if len(n) else []
        out, low = [], 0
        for high in ends:
            out.append(tokens[low:high])
            low = high
        odd = sorted(odd)
        for k, x in zip(odd, self._whole([texts[k] for k in odd]), strict=True):
            out[k] = x
        return out
