"""Tokenizing whole texts with the ``tokenizers`` library, fast where words repeat.

A text is cut at single spaces between two characters that are not white space.  Both vocabularies start a new piece at
such a place whatever surrounds it, so the ids of a text are those of its parts in order, and a part that was seen before
need not be encoded again.  ``tests/llm`` holds this against encoding whole texts.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A part that may be encoded beside others: one leading space at most, and no combining or rare characters beside it.
_SIMPLE = re.compile(r" ?[!-~\u00a1-\u024f][ -~\u00a1-\u024f\n]*(?<! )\Z").match
#: Tail of a part: ASCII punctuation but for the apostrophe, eight at most, after one of the letters or digits.
_TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_STEM_END = frozenset(c for c in map(chr, [*range(48, 123), *range(0xC0, 0x250)]) if c.isalnum())
#: Letters of the Latin blocks, but for the one whose lower case isn't a letter alone.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+\Z").match
#: Bytes as byte-level vocabularies spell them.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


_ID = attrgetter("id")


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Encodes texts to little-endian 32-bit ids.

    ``keep`` bounds the parts remembered (about 250 bytes each) in two generations, of which the older goes when the newer
    is full; it changes speed, never results.  Strings of added tokens in a text are these tokens, as the library has it,
    or ordinary text where ``special`` is false.  An empty text has no ids.  Other kinds of vocabularies than the two that
    the cutting holds for are asked for whole texts.
    """

    def __init__(self, path: str, keep: int = 400_000, special: bool = True):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        added = [t for t in spec["added_tokens"] if not t["special"] or special]
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in added)
        self._cuts = simple and _shape(spec) in _SHAPES
        if not self._cuts:
            self._whole = Tokenizer.from_file(path)
            self._whole.encode_special_tokens = not special
        self._added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self._divide = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._lead = " " if (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" else ""
        self._fold = not self._lead
        self._break = np.asarray(self._plain.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        self._keep, self._known, self._old, self._first, self._tails = keep, {}, {}, {}, {}

    def _letters(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of parts that are letters alone: each is one piece for either vocabulary, so the library's model is asked at once."""
        ids, ends, ask = [], [0], self._plain.model.tokenize
        for w in words:
            if self._fold:
                w = w.lower()
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(_BYTES)
            ids.extend(map(_ID, ask(lead + w)))
            ends.append(len(ids) * 4)
        body = np.array(ids, "<u4").tobytes()
        return [body[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part on its own: parts that begin or are parted by a space are encoded together and divided by character offsets."""
        out: list[bytes] = []
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            if (self._lead and some[0][0] != " ") or not all(map(_SIMPLE, some)):
                out += [np.asarray(e.ids, "<u4").tobytes() for e in self._plain.encode_batch(some, add_special_tokens=False)]
                continue
            glue = "" if some[0][0] == " " else " "
            e = self._plain.encode(glue.join(some), add_special_tokens=False)
            ids = np.asarray(e.ids, "<u4").tobytes()
            begins = np.fromiter((x[0] for x in e.offsets), np.int64, len(e.offsets))
            first = np.cumsum([0, *(len(p) + len(glue) for p in some)])
            at = (np.searchsorted(begins, first) * 4).tolist()
            out += [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _learn(self, known: dict[str, bytes], new: set[str], lead: str) -> None:
        """Ids of new parts.  A run of punctuation after a letter or digit is a piece of its own, so a part that ends in one
        is encoded as its stem and its tail, which recur more than the whole."""
        stems, whole, tails, lines, words = [], set(), self._tails, [], []
        for p in new:
            if p.isascii() and p.isalpha():
                words.append(p)
                continue
            if "\n" in p:
                parts = p.split("\n")
                if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
                    lines.append((p, parts))
                    continue
            stem = p.rstrip(_TAIL)
            if 0 < len(p) - len(stem) <= 8 and stem[-1:] in _STEM_END and "\n" not in stem:
                tail = p[len(stem) :]
                stems.append((p, stem, tail))
                if stem not in known:
                    whole.add(stem)
                if tail not in tails:
                    tails[tail] = np.asarray(self._plain.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                whole.add(p)
        whole.difference_update(words)
        letters = [p for p in whole if (p.isascii() and p.isalpha()) or _LETTERS(p)]
        whole.difference_update(letters)
        words += letters
        known.update(zip(words, self._letters(words, "\u0120" if lead else ""), strict=True))
        rest = list(whole)
        known.update(zip(rest, self._encode_parts([lead + p for p in rest]), strict=True))
        for p, stem, tail in stems:
            known[p] = known[stem] + tails[tail]
        if lines:  # a single line end between other characters is a piece of its own, or none
            first = self._first if self._lead else known
            self._learn(known, {parts[0] for _, parts in lines if parts[0] not in known}, lead)
            self._learn(first, {x for _, parts in lines for x in parts[1:] if x not in first}, "")
            for p, parts in lines:
                known[p] = self._break.join([known[parts[0]], *(first[x] for x in parts[1:])])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: empty)."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not self._cuts:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self._whole.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        odd: set[int] = set()
        for s in self._added:
            odd.update(np.flatnonzero(pc.match_substring(column, s).to_numpy(zero_copy_only=False)).tolist())
        if not odd:
            return self._encode(column)
        pieces = [self._divide.split(t) if i in odd else [t] for i, t in enumerate(column.to_pylist())]
        got = iter(self._encode(pa.array([x for p in pieces for x in p[::2]], pa.string())))
        return [b"".join(self._added[x] if k % 2 else next(got) for k, x in enumerate(p)) for p in pieces]

    def _encode(self, column: pa.Array) -> list[bytes]:
        was = gc.isenabled()
        gc.disable()  # nothing here is cyclic
        try:
            return self._join(column)
        finally:
            if was:
                gc.enable()

    def _join(self, column: pa.Array) -> list[bytes]:
        """Cuts all texts at once, gets the ids of their distinct parts, and lays these out in the parts' order."""
        if len(self._known) > self._keep // 2:
            self._known, self._old = {}, self._known
        if len(self._first) > self._keep // 4:
            self._first = {}
        if len(self._tails) > 50_000:
            self._tails = {}
        split = pc.split_pattern(column, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        names, place, at = _strings(coded.dictionary), coded.indices.to_numpy(), at - at[0]
        known, first, old = self._known, self._first, self._old
        bodies = list(map(known.get, names))
        missing = [k for k, b in enumerate(bodies) if b is None]
        odd = [k for k in missing if not (p := names[k]) or p.strip() != p]
        if odd:  # some cuts lie beside white space
            mark = np.zeros(len(names), bool)
            mark[odd] = True
            again = set((np.searchsorted(at, np.flatnonzero(mark[place]), "right") - 1).tolist())
            split = [_CUT.split(t) if k in again else t.split(" ") for k, t in enumerate(column.to_pylist())]
            at = np.concatenate(([0], np.cumsum([len(x) for x in split])))
            coded = pa.array([p for x in split for p in x], pa.string()).dictionary_encode()
            names, place = _strings(coded.dictionary), coded.indices.to_numpy()
            bodies = list(map(known.get, names))
            missing = [k for k, b in enumerate(bodies) if b is None]
        new = set()
        for k in missing:
            p = names[k]
            if p in old:
                known[p] = old[p]
            elif p:
                new.add(p)
        self._learn(known, new, self._lead)
        for k in missing:
            bodies[k] = known.get(names[k], b"")
        if self._lead:
            begin = [names[k] for k in place[at[:-1]].tolist()]
            self._learn(first, {p for p in begin if p and p not in first}, "")
            place = place.astype(np.int64)
            place[at[:-1]] = len(names) + np.arange(len(begin))
            bodies += [first[p] if p else b"" for p in begin]
        size = np.fromiter(map(len, bodies), np.int64, len(bodies)) >> 2
        source = np.frombuffer(b"".join(bodies), "<u4")
        each = size[place]
        ends = np.cumsum(each)
        out = source[np.repeat((np.cumsum(size) - size)[place] - (ends - each), each) + np.arange(int(each.sum()))].tobytes()
        edge = (np.concatenate(([0], ends))[at] * 4).tolist()
        return [out[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _shape(spec: dict) -> tuple[str, str, str]:
    """What a vocabulary does before its model, without the tokens."""
    return tuple(json.dumps(spec.get(k), sort_keys=True) for k in ("normalizer", "pre_tokenizer")) + (spec["model"]["type"] + str(spec["model"].get("continuing_subword_prefix")) + str(spec["model"].get("byte_fallback")),)


_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Those that start a new piece at every single space between other characters.
_SHAPES = {
    _shape({"pre_tokenizer": _BYTE_LEVEL | {"use_regex": True}, "model": {"type": "BPE", "byte_fallback": False}}),
    _shape(
        {
            "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
            "model": {"type": "BPE", "byte_fallback": False},
        }
    ),
}


_CACHE: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, keep: int = 400_000) -> TextEncoder:
    """One encoder a Python worker, so that tasks after the first find their words known."""
    if (path, keep) not in _CACHE:
        _CACHE.clear()
        _CACHE[path, keep] = TextEncoder(path, keep)
    return _CACHE[path, keep]
