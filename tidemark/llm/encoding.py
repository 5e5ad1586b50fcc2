"""Tokenizing whole texts with a public tokenizer, each distinct word once per worker.

A tokenizer of the ``tokenizers`` library cuts a text into pieces before its merges, and a single space between two
visible Latin characters always ends a piece.  So a text is cut there, each distinct unit is encoded by the library
once and kept, and a text's ids are the ids of its units in a row.  Texts that break the rule's conditions somewhere
(runs of white space, other scripts at a cut) are cut only where it holds.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A cut is allowed only between two of these (visible ASCII and Latin letters; no white space, no combining marks).
_SAFE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]))
_CUT = re.compile("(?<=[\x21-\x7e\xa1-ɏ]) (?=[\x21-\x7e\xa1-ɏ])")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LONGEST = 48
#: The key of a line's end between two safe characters.
_LINE = 0


class UnitEncoder:
    """Encodes texts; remembers up to ``most_units`` distinct units, then starts anew (memory stays bounded)."""

    def __init__(self, path: str, most_units: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the library takes out of a text before it cuts it: texts that hold one are encoded by it as a whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_units = most_units
        # what stands between units that are encoded in one call: a piece of its own, whose ids no such unit has
        self.joint, self.joint_ids = next((s, i) for s in ("\n", " 0 ") if len(i := self._ids(s)) == 1)
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.index: dict = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.length = np.empty(1 << 14, np.int64)
        self.odd = np.zeros(1 << 14, bool)
        ids = self._ids("\n")
        self._put([_LINE], np.asarray(ids, np.uint32), np.asarray([len(ids)]))

    def _room(self, ids: int, units: int) -> None:
        if self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), ids), np.uint32)])
        while len(self.index) + units > len(self.start):
            self.start, self.length, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.odd))

    def _put(self, keys: list, ids: np.ndarray, lens: np.ndarray) -> None:
        self._room(len(ids), len(keys))
        at = len(self.index)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(keys)] = self.used + np.cumsum(lens) - lens
        self.length[at : at + len(keys)] = lens
        self.used += len(ids)
        self.index.update(zip(keys, range(at, at + len(keys))))

    def _encode_plain(self, keys: list) -> None:
        """Units that are one word or one run of marks: all in one call, told apart by the joint's id."""
        if not keys:
            return
        text = self.joint.join([k[0] if type(k) is tuple else " " + k for k in keys])
        ids = np.asarray(self._ids(text), np.uint32)
        cuts = np.flatnonzero(ids == self.joint_ids[0])
        if len(cuts) != len(keys) - 1:
            return self._encode_whole(keys)
        lens = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        self._put(keys, np.delete(ids, cuts), lens)

    def _encode_whole(self, keys: list) -> None:
        if keys:
            got = [e.ids for e in self.tokenizer.encode_batch([k[0] if type(k) is tuple else " " + k for k in keys], add_special_tokens=False)]
            self._put(keys, np.asarray([i for g in got for i in g], np.uint32), np.asarray([len(g) for g in got], np.int64))

    def _learn(self, keys: list) -> None:
        """A key is a unit that follows a space, or a 1-tuple of one that doesn't."""
        known, plain, whole, made, odd = self.index, {}, [], [], []

        def word(key) -> list | None:
            """The keys that a unit without white space is made of; None: the library has to cut it."""
            s = key[0] if type(key) is tuple else key
            core = s.rstrip(_PUNCT)
            if core and not (core.isalpha() and len(core) <= _LONGEST and (core.isascii() or max(core) < "ɐ")):
                return None
            tail = s[len(core) :]
            if not core:
                out = [key]
            else:
                out = [(core,) if type(key) is tuple else core] + ([(tail,)] if tail else [])
            for k in out:
                if k not in known:
                    plain[k] = None
            return out

        for key in keys:
            lead = type(key) is not tuple
            s = key if lead else key[0]
            if not s or s[-1] not in _SAFE or s[0] not in _SAFE:
                odd.append(key)
                continue
            if s.isalpha() and len(s) <= _LONGEST and (s.isascii() or max(s) < "ɐ"):
                plain[key] = None
                continue
            of = word(key)
            if of is None:
                whole.append(key)
            elif len(of) > 1:
                made.append((key, of))
        self._encode_plain([k for k in plain if k not in known])
        self._encode_whole([k for k in whole if k not in known])
        made = [(k, of) for k, of in made if k not in known]
        if made:
            idx = np.fromiter((known[k] for _, of in made for k in of), np.int64)
            sizes = np.fromiter((len(of) for _, of in made), np.int64, len(made))
            ids, lens = self._gather(idx)
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(lens)])
            self._put([k for k, _ in made], ids, total[ends] - total[ends - sizes])
        if odd:
            at = len(known)
            self._put(odd, np.empty(0, np.uint32), np.zeros(len(odd), np.int64))
            self.odd[at : at + len(odd)] = True

    def _gather(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.length[idx]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.start[idx] - ends + lens, lens)
        where += np.arange(total)
        return self.flat[where], lens

    def _look_up(self, flat: list) -> np.ndarray:
        get = self.index.get
        idx = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(idx < 0)
        if len(missing):
            self._learn(list(dict.fromkeys([flat[i] for i in missing.tolist()])))
            idx[missing] = np.fromiter((self.index[flat[i]] for i in missing.tolist()), np.int64, len(missing))
        return idx

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each."""
        if len(self.index) > self.most_units:
            self._reset()
        special = {i: np.asarray(self._ids(t), np.uint32) for i, t in enumerate(texts) if t and any(s in t for s in self.added)}
        if special:
            return self._with_whole([None if i in special else t for i, t in enumerate(texts)], special)
        flat: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                had = len(flat)
                for line in t.split("\n"):
                    units = line.split(" ")
                    units[0] = (units[0],)
                    flat += units
                    flat.append(_LINE)
                flat.pop()
                counts[i] = len(flat) - had
        idx = self._look_up(flat)
        ends = np.cumsum(counts)
        bad = np.unique(np.searchsorted(ends, np.flatnonzero(self.odd[idx]), side="right")) if len(idx) else []
        if len(bad):
            again: list[list] = []
            for i in bad:
                units = _CUT.split(texts[i])
                again.append([(units[0],), *units[1:]])
            odd = {k for us in again for k in us if (j := self.index.get(k)) is None or self.odd[j]}
            new = self._encode_apart(odd)
            return self._splice(texts, idx, counts, ends, {int(b): u for b, u in zip(bad, again)}, new)
        ids, lens = self._gather(idx)
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids, total[ends] - total[ends - counts]

    def _with_whole(self, texts: list, done: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = self.encode(texts)
        out, ends = [], np.cumsum(lens)
        for i, (end, n) in enumerate(zip(ends.tolist(), lens.tolist())):
            out.append(done[i] if i in done else ids[end - n : end])
        return np.concatenate(out), np.asarray([len(x) for x in out], np.int64)

    def _encode_apart(self, keys) -> dict:
        keys = list(keys)
        got = self.tokenizer.encode_batch([k[0] if type(k) is tuple else " " + k for k in keys], add_special_tokens=False)
        return {k: np.asarray(g.ids, np.uint32) for k, g in zip(keys, got)}

    def _splice(self, texts, idx, counts, ends, again: dict, new: dict) -> tuple[np.ndarray, np.ndarray]:
        out, lens = [], np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            if i in again:
                ids = np.concatenate([new[k] if k in new else self._gather(np.asarray([self.index[k]]))[0] for k in again[i]])
            else:
                ids = self._gather(idx[ends[i] - counts[i] : ends[i]])[0]
            out.append(ids)
            lens[i] = len(ids)
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), lens


def encoder(path: str) -> UnitEncoder:
    """The worker's own encoder of a tokenizer file, kept from task to task."""
    return held(f"encoder {path}", lambda: UnitEncoder(path))
