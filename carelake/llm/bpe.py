"""Byte-pair encoding by one pass of dynamic programming over a word's prefixes, and decoding.

Every prefix of a word has one encoding, and so one last token. An automaton over all tokens names those that end at
a place; of these the one counts that may follow the last token of the prefix before it. Two tokens may stand side by
side if no merge across their border comes before the merges that build them. The word's ids are read off backwards,
so only those prefixes are looked at that a token of the word's end leads to.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text. Texts are processed whole.
Repeated rows and ids give equal rows. Columns other than the id and the text are not read unless asked for.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from array import array
from functools import cache, cached_property

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelake.llm.common import map_rows, ship, text_of

#: Stands for the end of a word in the automaton; no token holds it.
END = "\n"
SUFFIX = "</w>"
#: Words a worker remembers: the newest so many, and those used again of as many before. Longer ones never.
REMEMBERED, LONGEST = 170_000, 40
#: Pairs of tokens whose test a worker remembers, until it begins anew.
PAIRS = 200_000
#: Ways from state to state that a worker's automaton remembers besides the tokens' own; others are found anew each time.
WAYS = 200_000
NO_ID = -1

# How the vocabulary's own tokenizer cuts a lower-case text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Python takes these for white space, the tokenizer does not.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Outside these blocks Unicode versions differ: there the tokenizer library itself normalizes and cuts the text.
SETTLED = regex.compile(r"[\x00-\u02ff\u0370-\u0373\u0384-\u052f\u2010-\u2027\u2030-\u205e\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


@cache
def byte_symbols() -> dict[int, str]:
    """A printable character for every byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class State(dict):
    """A state of the automaton: the states that symbols lead to. Those beyond the tokens' own are found when first asked for."""

    __slots__ = ("ending", "shorter", "spare")

    def __init__(self, shorter: State | None) -> None:
        #: The state of the longest other end of what was read; the first state has none.
        self.shorter = shorter
        #: How many more ways all states together may remember.
        self.spare: list[int] = [WAYS] if shorter is None else shorter.spare
        #: The tokens that end here, the longest first.
        self.ending: tuple[int, ...] = ()

    def __missing__(self, symbol: str) -> State:
        after = self if self.shorter is None else self.shorter[symbol]
        # A symbol that begins no token leads back to the first state; there are too many such to remember each.
        if after.shorter is not None and self.spare[0] > 0:
            self.spare[0] -= 1
            self[symbol] = after
        return after


def automaton(keys: dict[str, int]) -> State:
    """The first state of the automaton that finds `keys`."""
    first = State(None)
    layer: list[tuple[State, list[str]]] = [(first, sorted(keys))]
    depth = 0
    while layer:  # all states of a depth before the next: what is shorter is done
        deeper = []
        for state, below in layer:
            parts: dict[str, list[str]] = {}
            for key in below:
                if len(key) > depth:
                    parts.setdefault(key[depth], []).append(key)
            # asked before any of them is set, as the first state would answer with the new one itself
            shorter = {symbol: first if state is first else state.shorter[symbol] for symbol in parts}
            for symbol, longer in parts.items():
                made = state[symbol] = State(shorter[symbol])
                token = keys.get(longer[0]) if len(longer[0]) == depth + 1 else None
                made.ending = shorter[symbol].ending if token is None else (token, *shorter[symbol].ending)
                deeper.append((made, longer))
        layer = deeper
        depth += 1
    return first


class Vocabulary:
    """Tokens, the merge that builds each, and the automaton that finds them."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.base = max(self.tokens, default=0) + 1  # a pair of tokens as one number
        self.rank: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}  # the rank of the merge that makes a token
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault(x * self.base + y, rank)
            if whole not in self.made:
                self.left[whole], self.right[whole], self.made[whole] = x, y, rank
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.known: dict[int, bool] = {}
        keys = {t.removesuffix(SUFFIX) + END * t.endswith(SUFFIX): i for t, i in self.ids.items() if self._whole(i, t)}
        self.length = array("I", [0]) * self.base
        for key, i in keys.items():
            self.length[i] = len(key)
        self.first = automaton(keys)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

        self.spines.clear()  # of all tokens; few are asked for again

    def _whole(self, token: int, text: str) -> bool:
        """Whether the token's own text is encoded as this one token."""
        if token not in self.made:
            return len(text.removesuffix(SUFFIX)) == 1
        return self._side_by_side(self.left[token], self.right[token], self.made[token])

    def _spine(self, token: int, at_right: bool) -> list[tuple[int, float]]:
        """The tokens at one border, from the single symbol up, each with the rank of the merge that ends it."""
        if (found := self.spines.get((token, at_right))) is None:
            child = self.right if at_right else self.left
            found = [(token, float("inf"))]
            while (t := found[-1][0]) in self.made:
                found.append((child[t], self.made[t]))
            self.spines[token, at_right] = found = found[::-1]
        return found

    def _side_by_side(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border between a and b comes before the merges that build them."""
        ours, theirs = self._spine(a, True), self._spine(b, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = ours[i], theirs[j]
            merge = self.rank.get(x * self.base + y)
            # Of equal merges the leftmost comes first: the one within a before this one, this one before that in b.
            if merge is not None and merge < x_ends and merge <= y_ends and merge < before:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def may_follow(self, a: int, b: int) -> bool:
        pair = a * self.base + b
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[pair] = self._side_by_side(a, b)
        return found

    def word(self, text: str) -> list[int]:
        """The ids of one word."""
        if not (text.isascii() and text.isprintable()):
            symbols = byte_symbols()
            text = "".join([symbols[b] for b in text.encode()])
        return self.symbols(text)

    def symbols(self, text: str) -> list[int]:
        """The ids of one word that is given in byte symbols."""
        text += END
        size = len(text)
        state = self.first
        ending = [(state := state[symbol]).ending for symbol in text]
        known, base, length = self.known, self.base, self.length
        last: list[int | None] = [0, *[None] * size]
        asked = [0]
        end = size
        while end:
            for token in ending[end - 1]:
                begin = end - length[token]
                if begin:
                    before = last[begin]
                    if before is None:
                        asked.append(end)
                        end = begin
                        break
                    if before == NO_ID:
                        continue
                    fits = known.get(before * base + token)
                    if not (self.may_follow(before, token) if fits is None else fits):
                        continue
                last[end] = token
                end = asked.pop()
                break
            else:
                last[end] = NO_ID
                end = asked.pop()
        out = []
        while size and (token := last[size]) != NO_ID:
            out.append(token)
            size -= length[token]
        out.reverse()
        if size or "".join(map(self.tokens.__getitem__, out)) != text[:-1] + SUFFIX:
            raise ValueError(f"a word of {len(text) - 1} symbols does not come back from its ids")
        return out


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Coder:
    """Encodes and decodes whole texts; remembers a bounded number of words."""

    def __init__(self, content: str) -> None:
        self.vocabulary = Vocabulary(content)
        self.pattern = regex.compile(WORDS)
        self.content = content
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.content)

    def _word(self, word: str) -> bytes:
        return self.new.get(word) or self._piece(word, True)

    def _piece(self, piece: str, one_word: bool = False) -> bytes:
        """What stands between white space, or one word of it."""
        packed = self.old.get(piece)
        if packed is None:
            if one_word or piece.isalpha():
                packed = _pack(self.vocabulary.word(piece))
            elif piece[:-1].isalpha() and piece[-1] in ".,":
                packed = self._word(piece[:-1]) + self._word(piece[-1])
            else:
                packed = b"".join(map(self._word, self.pattern.findall(piece)))
        if len(piece) <= LONGEST:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[piece] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not SETTLED.fullmatch(text):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return b"".join([_pack(self.vocabulary.symbols(w)) for w, _ in words])
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # its lower case does not depend on its place here
                text = text.replace("Σ", "σ")
        text = text.lower()
        pieces = regex.split(r"[^\S\x1c-\x1f]+", text) if SEPARATORS.search(text) else text.split()
        known, piece = self.new.get, self._piece
        return b"".join([known(p) or piece(p) for p in pieces if p])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pattern = self.vocabulary.special_pattern
        if pattern is None or not pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in pattern.finditer(text):
            out += [self._plain(text[at : found.start()]), self.vocabulary.special[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        """The tokens' texts with one space between them, as a tokenizer without a decoder does it."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, memoryview(packed).cast("I")))


#: The coder of this worker, which lives on from task to task with the words it remembers, and the tokenizer it is for.
_KEPT: dict[str, Coder] = {}


def _coder(content: str) -> Coder:
    if content not in _KEPT:
        _KEPT.clear()
        _KEPT[content] = Coder(content)
    return _KEPT[content]


def read_spec(spark: SparkSession, path: str) -> str:
    """The tokenizer's file: a vocabulary, so bounded; the tasks get it from the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_decode(df: DataFrame, spec: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), arrays: bool = False, decoded: bool = True) -> DataFrame:
    """`keep`, `packed_ids` (binary, little-endian unsigned 32-bit) and `decoded` for every row.

    With `arrays` the ids come as `token_ids`, an array of integers, instead. Without `decoded` no texts are returned: a
    word's ids are decoded when it is first encoded, and a word that does not come back fails the task.

    `spec` is the content of a tokenizer file whose model is byte-pair encoding over byte symbols with word ends.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)
    names = [f"k{i}" for i in range(len(keep))]

    def make():
        coder = _coder(shared.value)

        def row(text, *kept):
            packed = coder.encode(text)
            ids = np.frombuffer(packed, "<u4").astype("i4") if arrays else packed
            yield (*kept, ids, coder.decode(packed)) if decoded else (*kept, ids)

        return row

    chosen = df.select(text_of(text).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    made = ["ids array<int>" if arrays else "ids binary", *["decoded string"] * decoded]
    schema = ", ".join([f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)] + made)
    return map_rows(chosen, make, schema).toDF(*keep, "token_ids" if arrays else "packed_ids", *["decoded"] * decoded)


def count_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def unpack_ids(df: DataFrame, packed: str = "packed_ids", out: str = "token_ids") -> DataFrame:
    """Adds the ids as an array of integers."""
    ship(df.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = [None if v is None else np.frombuffer(v, "<u4").astype("i4") for v in batch.column(packed).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))
