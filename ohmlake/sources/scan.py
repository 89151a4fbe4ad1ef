"""Plain schematic files as columns: brackets, strings and atoms of many files are found at once in numpy.

What comes out is what ``designs.schematic_items`` gives, by columns. Files in which something is unusual (escapes, text beyond ASCII
outside of strings, brackets that do not match, places that are no numbers, names where values should stand, ...) are odd:
they are named, not read, and the reader that goes token by token takes them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

_SPACE, _ATOM, _QUOTE, _OPEN, _CLOSE, _OTHER = range(6)
_CLASS = np.full(256, _ATOM, np.uint8)
_CLASS[[*range(9, 14), *range(28, 33)]] = _SPACE
_CLASS[ord('"')], _CLASS[ord("(")], _CLASS[ord(")")] = _QUOTE, _OPEN, _CLOSE
_CLASS[128:] = _OTHER
_TABLE = _CLASS.tobytes()
_DIGITS = np.zeros(256, bool)
_DIGITS[list(b"0123456789.-+eE")] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Fixed value: lists in lists; deeper files are odd.
DEEPEST = 64

META = ("version", "generator", "generator_version", "uuid", "paper")
LABELS = ("label", "hierarchical_label", "global_label")
#: Kinds of items and the entity of their rows.
KINDS = dict.fromkeys(META, "meta") | {k: k for k in ("wire", "bus", "junction", "no_connect", "bus_entry", "symbol", "text", "sheet", "global_label")}
KINDS |= {"label": "label", "hierarchical_label": "label", "title_block": "title", "lib_symbols": "library_symbol"}
_NAMES = list(KINDS)


def _number(name: str) -> int:
    return int.from_bytes(name.encode()[:8], "little")


#: Names of lists within items, none longer than eight bytes, by their bytes as a number.
_PARTS = sorted(["at", "xy", "length", "symbol", "pts", "property", "pin", "unit", "uuid", "effects", "number", "name"], key=_number)
_WORDS = np.array([_number(n) for n in _PARTS], np.uint64)


class Odd(Exception):
    """Files that are odd, as a mask."""


class Scan:
    """Items of plain files in order: file, kind, the ordinal of the first row and the number of rows of each, and their columns.

    ``effects`` gives the JSON of one list of effects.
    """

    def __init__(self, texts: pa.Array, effects: Callable[[str], str]):
        self.size, self.effects = len(texts), effects
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.size + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets, self.data = offsets - offsets[0], data
        # the eight bytes from each place on, as a number
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        self.words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        self._tokens()
        self._lists()
        self._items()

    def _odd(self, mask: np.ndarray) -> None:
        if mask.any():
            raise Odd(mask)

    def _odd_at(self, places: np.ndarray) -> None:
        """The files of places in the text are odd."""
        if len(places):
            self._odd(np.bincount(np.searchsorted(self.offsets, places, "right") - 1, minlength=self.size) > 0)

    def _odd_tokens(self, tokens: np.ndarray) -> None:
        self._odd_at(self.at[tokens])

    def _tokens(self) -> None:
        data, offsets, raw = self.data, self.offsets, self.data.tobytes()
        self._odd(offsets[1:] == offsets[:-1])
        self._odd(data[offsets[:-1]] != ord("("))
        # seen first, as files of other kinds may be many
        root = offsets[:-1] + 1
        self._odd((self.words[root] != np.uint64(_number("kicad_sc"))) | (self.words[root + 8] & _MASK[1] != ord("h")) | (_CLASS[self.words[root + 9] & _MASK[1]] == _ATOM))
        for odd in (b"\\", b"\0"):
            if odd in raw:
                self._odd_at(np.flatnonzero(data == odd[0]))
        of = np.frombuffer(raw.translate(_TABLE), np.uint8)
        quote = of == _QUOTE
        # from an opening quote up to the place before its closing one
        inside = np.cumsum(quote.view(np.uint8), dtype=np.uint8) & 1
        within = inside[offsets[1:] - 1]
        self._odd(within != np.concatenate([[0], within[:-1]]))
        out = of & (inside - 1)
        if not raw.isascii():
            self._odd_at(np.flatnonzero(out == _OTHER))
        atom = out == _ATOM
        self._odd(atom[offsets[1:] - 1])
        # where tokens begin and where they end: a text's first and last bytes are no atoms
        begin, end = out >= _OPEN, out >= _QUOTE
        begin |= quote & inside.view(bool)
        begin[1:] |= atom[1:] > atom[:-1]
        end[:-1] |= atom[:-1] > atom[1:]
        self.at = at = np.flatnonzero(begin)
        self.kind = kind = of[at]
        self.first = at + (kind == _QUOTE)
        self.last = np.flatnonzero(end)
        self.last += kind == _ATOM
        # wraps only in files deeper than the limit
        self.depth = depth = np.cumsum((kind == _OPEN).view(np.int8) - (kind == _CLOSE).view(np.int8), dtype=np.int8)
        self.starts = starts = np.searchsorted(at, offsets)
        self._odd(depth[starts[1:] - 1] != depth[starts[:-1]] - np.int8(1))
        self._odd(np.maximum.reduceat(depth, starts[:-1]) > DEEPEST)
        zero = np.flatnonzero(depth <= 0)
        self._odd(np.diff(np.searchsorted(zero, starts)) != 1)
        # what stands after the last token is never asked for, but its place may be
        self.kind = np.concatenate([kind, np.full(4, _CLOSE, np.uint8)])

    def _flat(self, tokens: np.ndarray) -> np.ndarray:
        """Whether tokens are strings or atoms."""
        return self.kind[tokens] < _OPEN

    def _word(self, tokens: np.ndarray, skip: int = 0) -> np.ndarray:
        """Up to eight bytes of tokens as a number; no text has bytes of zero."""
        first = self.first[tokens] + skip
        long = np.clip(self.last[tokens] - first, 0, 8)
        return self.words[first] & _MASK[long]

    def _is(self, tokens: np.ndarray, word: np.ndarray, name: str) -> np.ndarray:
        """Whether tokens, whose first words are known, are a name."""
        raw = name.encode()
        same = word == np.uint64(_number(name))
        some = np.flatnonzero(same)
        same[some] = self.last[tokens[some]] - self.first[tokens[some]] == len(raw)
        for skip in range(8, len(raw), 8):
            some = np.flatnonzero(same)
            same[some] = self._word(tokens[some], skip) == np.uint64(int.from_bytes(raw[skip : skip + 8], "little"))
        return same

    def _lists(self) -> None:
        """Lists by level (the file's is 1, items are 2), their names, the item and the part of an item that each is in."""
        self.open = o = np.flatnonzero(self.kind == _OPEN)
        self.level = self.depth[o]
        self._odd_tokens(o[~self._flat(o + 1)])
        self.word = self._word(o + 1)
        code = np.minimum(np.searchsorted(_WORDS, self.word), len(_WORDS) - 1).astype(np.int8)
        self.code = np.where((_WORDS[code] == self.word) & (self.last[o + 1] - self.first[o + 1] <= 8), code, np.int8(-1))
        self.item = np.cumsum((self.level == 2).view(np.int8), dtype=np.int64) - 1
        self.part = np.cumsum((self.level == 3).view(np.int8), dtype=np.int64) - 1
        self._places()

    def _named(self, name: str, level: int | None = None) -> np.ndarray:
        """Lists of a name among _PARTS, as numbers of lists."""
        same = self.code == _PARTS.index(name)
        return np.flatnonzero(same if level is None else same & (self.level == level))

    def _numbers(self, tokens: np.ndarray) -> np.ndarray:
        long = self.last[tokens] - self.first[tokens]
        self._odd_tokens(tokens[long == 0])
        raw, ends = self._bytes(tokens)
        if not _DIGITS[raw].all():
            wrong = np.searchsorted(ends, np.flatnonzero(~_DIGITS[raw]), "right") - 1
            self._odd_tokens(tokens[wrong])
        try:
            return self._array(raw, ends).cast(pa.float64()).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:
            raise Odd(np.ones(self.size, bool)) from None

    def _places(self) -> None:
        """Numbers of all lists at, xy and length, wherever they stand: if one is none, its file is odd."""
        at, xy, long = self._named("at"), self._named("xy"), self._named("length")
        o = self.open
        two = np.concatenate([o[at], o[xy]])
        self._odd_tokens(two[~(self._flat(two + 2) & self._flat(two + 3))])
        self._odd_tokens(o[at][self.kind[o[at] + 4] == _OPEN])
        turned = self._flat(o[at] + 4)
        lengths = o[long][self._flat(o[long] + 2)] + 2
        self._numbers(lengths[self.last[lengths] > self.first[lengths]])
        found = self._numbers(np.concatenate([two + 2, two + 3, o[at][turned] + 4]))
        x, y, r = np.split(found, [len(two), 2 * len(two)])
        self.at_list, self.at_x, self.at_y, self.at_turned, self.at_r = at, x[: len(at)], y[: len(at)], turned, r
        self.xy_list, self.xy_x, self.xy_y = xy, x[len(at) :], y[len(at) :]

    def _items(self) -> None:
        item, o, level = np.flatnonzero(self.level == 2), self.open, self.level
        self.items, tokens = item, o[item]
        self.file = np.searchsorted(self.starts, tokens, "right") - 1
        kind = np.full(len(item), -1)
        for i, name in enumerate(_NAMES):
            kind[self._is(tokens + 1, self.word[item], name)] = i
        self.kinds = kind
        self.is_kind = lambda *names: np.isin(kind, [_NAMES.index(n) for n in names])
        third = level == 3
        self.parts = np.flatnonzero(third)
        lists = np.bincount(self.item[third], minlength=len(item))
        count = (kind >= 0).astype(np.int64)
        # of a title's lists and a library's symbols those with a second element are rows
        wide = third & (self.kind[o + 2] != _CLOSE)
        symbols = np.zeros(len(o), bool)
        symbols[self._named("symbol", 3)] = True
        for name, own in (("title_block", wide), ("lib_symbols", wide & symbols)):
            of = np.bincount(self.item[own], minlength=len(item))
            count = np.where(self.is_kind(name), of, count)
        # symbols have three elements at least; the second is the library's name or a list with it
        symbol, second = self.is_kind("symbol"), self.kind[tokens + 2]
        self.by_list = by_list = symbol & (second == _OPEN)
        self._odd_tokens(tokens[by_list & (lists < 2)])
        count[symbol & ((second == _CLOSE) | (self._flat(tokens + 2) & (self.kind[tokens + 3] == _CLOSE)))] = 0
        ahead = np.zeros(len(o) + 1, bool)
        for name in ("at", "property", "pin"):
            ahead[self._named(name, 3)] = True
        self._odd_tokens(tokens[by_list & ahead[item + 1]])
        self._odd_tokens(tokens[self.is_kind(*LABELS) & (second == _OPEN)])
        self.count = count
        ends = np.cumsum(count)
        before = np.concatenate([[0], ends])[np.searchsorted(self.file, np.arange(self.size))]
        self.ordinal = ends - count - before[self.file]

    # ------------------------------------------------------------ columns

    def _bytes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens laid end to end, and where each begins; token -1 has none."""
        long = np.where(tokens < 0, 0, self.last[tokens] - self.first[tokens])
        ends = np.concatenate([[0], np.cumsum(long)])
        places = np.arange(ends[-1]) + np.repeat(self.first[tokens] - ends[:-1], long)
        return self.data[places], ends

    def _array(self, raw: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])

    def strings(self, tokens: np.ndarray) -> pa.Array:
        return self._array(*self._bytes(tokens))

    def _or_none(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens that are strings or atoms, -1 for others."""
        return np.where(self._flat(tokens), tokens, -1)

    def at_of(self, owner: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last place of each owner, of lists at a level; the last turn that is given."""
        own = self.level[self.at_list] == level
        x, y, r = np.zeros(size), np.zeros(size), np.zeros(size)
        of = owner[self.at_list[own]]
        x[of], y[of] = self.at_x[own], self.at_y[own]
        turns = own[self.at_turned]
        r[owner[self.at_list[own & self.at_turned]]] = self.at_r[turns]
        return x, y, r

    def rows(self, entity: str) -> np.ndarray:
        """Items that are rows of an entity."""
        return np.flatnonzero(self.is_kind(*[k for k, e in KINDS.items() if e == entity]) & (self.count > 0))

    def slices(self, items: np.ndarray) -> list[str]:
        """Items as texts."""
        ends = self.at[(self.kind[: len(self.at)] == _CLOSE) & (self.depth == 1)] + 1
        raw = self.data
        return [raw[a:b].tobytes().decode() for a, b in zip(self.at[self.open[self.items[items]]], ends[items])]

    def wires(self, items: np.ndarray, fields: list[str]) -> dict:
        n = len(self.items)
        points = self._named("pts", 3)
        inside = np.zeros(len(self.parts) + 1, bool)
        inside[self.part[points]] = True
        own = (self.level[self.xy_list] == 4) & inside[self.part[self.xy_list]]
        of, x, y = self.item[self.xy_list[own]], self.xy_x[own], self.xy_y[own]
        many = np.bincount(of, minlength=n)
        begins = np.cumsum(many) - many
        two = many[items] >= 2
        pick = lambda v, i: np.where(two, np.concatenate([v, [0.0, 0.0]])[np.where(two, begins[items] + i, 0)], 0.0)
        return {"x1": pick(x, 0), "y1": pick(y, 0), "x2": pick(x, 1), "y2": pick(y, 1)}

    def places(self, items: np.ndarray, fields: list[str]) -> dict:
        return {k: v[items] for k, v in zip(("x", "y", "rotation"), self.at_of(self.item, 3, len(self.items)))}

    def labels(self, items: np.ndarray, fields: list[str]) -> dict:
        text = self.strings(self._or_none(self.open[self.items[items]] + 2))
        kind = pa.DictionaryArray.from_arrays(pa.array(self.kinds[items], pa.int32()), _NAMES).cast(pa.string())
        return {"text": text, "type": kind} | self.places(items, fields)

    def symbols(self, items: np.ndarray, fields: list[str]) -> dict:
        n, o = len(self.items), self.open
        tokens, by_list = o[self.items[items]], self.by_list[items]
        out = self.places(items, fields)
        out["library_id"] = self.strings(self._or_none(np.minimum(tokens + np.where(by_list, 4, 2), len(self.at) - 1)))
        row = np.full(n, -1)
        row[items] = np.arange(len(items))

        def own(name: str) -> np.ndarray:
            found = self._named(name, 3)
            return found[row[self.item[found]] >= 0]

        for name in ("unit", "uuid"):
            if name in fields:
                token, found = np.full(len(items), -1), own(name)
                token[row[self.item[found]]] = self._or_none(o[found] + 2)
                out[name] = self.strings(token)
        props = own("property")
        props = props[self.kind[o[props] + 2] != _CLOSE]
        self._odd_tokens(o[props][self.kind[o[props] + 2] == _OPEN])
        props = props[self.kind[o[props] + 3] != _CLOSE]
        self._odd_tokens(o[props][self.kind[o[props] + 3] == _OPEN])
        of = row[self.item[props]]
        word = self._word(o[props] + 2)
        for name, title in (("reference", "Reference"), ("value", "Value"), ("footprint", "Footprint")):
            if name in fields:
                token, same = np.full(len(items), -1), self._is(o[props] + 2, word, title)
                token[of[same]] = o[props][same] + 3
                out[name] = self.strings(token)
        if "properties" in fields:
            out["properties"] = self._listed(of, len(items), self._properties(props))
        pins = own("pin")
        pins = pins[self.kind[o[pins] + 2] != _CLOSE]
        self._odd_tokens(o[pins][self.kind[o[pins] + 2] == _OPEN])
        pins = pins[self.kind[o[pins] + 3] != _CLOSE]
        # instances mostly have no fields of their own
        is_pin = np.zeros(len(self.parts) + 1, bool)
        is_pin[self.part[pins]] = True
        for name in ("number", "name", "length", "at"):
            found = self._named(name, 4)
            self._odd_tokens(o[found[is_pin[self.part[found]]]])
        if "pins" in fields:
            blank, zero = self.strings(np.full(len(pins), -1)), np.zeros(len(pins))
            out["pins"] = self._listed(row[self.item[pins]], len(items), {"number": blank, "name": blank, "type": self.strings(o[pins] + 2), "length": zero, "x": zero, "y": zero})
        return out

    def _properties(self, props: np.ndarray) -> dict:
        o = self.open
        row = np.full(len(self.parts) + 1, -1)
        row[self.part[props]] = np.arange(len(props))
        x, y, r = (v[self.part[props]] for v in self.at_of(self.part, 4, len(self.parts) + 1))
        found = self._named("effects", 4)
        found = found[row[self.part[found]] >= 0]
        twice = np.bincount(row[self.part[found]], minlength=len(props)) > 1
        self._odd_tokens(o[props][twice])
        ends = self.at[(self.kind[: len(self.at)] == _CLOSE) & (self.depth == 3)] + 1
        fourth = np.cumsum(self.level == 4) - 1
        first, last = self.at[o[found]], ends[fourth[found]]
        starts = np.concatenate([[0], np.cumsum(last - first)])
        raw = self.data[np.arange(starts[-1]) + np.repeat(first - starts[:-1], last - first)]
        coded = self._array(raw, starts).dictionary_encode()
        texts = ["{}", *map(self.effects, coded.dictionary.to_pylist())]
        code = np.zeros(len(props), np.int32)
        code[row[self.part[found]]] = coded.indices.to_numpy() + 1
        effects = pa.DictionaryArray.from_arrays(pa.array(code), pa.array(texts, pa.string())).cast(pa.string())
        return {"name": self.strings(o[props] + 2), "value": self.strings(o[props] + 3), "x": x, "y": y, "rotation": r, "effects": effects}

    def _listed(self, of: np.ndarray, n: int, columns: dict) -> pa.Array:
        """Columns of parts as one column of lists, by the row that each part is of."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))
        return pa.ListArray.from_arrays(pa.array(ends), values)


#: Entities whose columns a scan has; of others it has the items' texts.
COLUMNS = {"wire": Scan.wires, "bus": Scan.wires, "junction": Scan.places, "label": Scan.labels, "symbol": Scan.symbols}


def plain(texts: pa.Array, effects: Callable[[str], str], made: Callable[[Scan, np.ndarray], Any]) -> tuple[Any, np.ndarray]:
    """(made of a scan of the plain files and their numbers, numbers of the odd files); made is null if none is plain."""
    odd = np.zeros(len(texts), bool)
    while not odd.all():
        own = np.flatnonzero(~odd)
        try:
            return made(Scan(texts.take(pa.array(own)) if odd.any() else texts, effects), own), np.flatnonzero(odd)
        except Odd as e:
            odd[own[e.args[0]]] = True
    return None, np.flatnonzero(odd)
