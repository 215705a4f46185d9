"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of many texts are laid end to end. An inverted index leads from each pair of neighbouring tokens (by the
rank of what they merge to) to the places where it stands; ranks are taken from a queue in order, every place of a rank is
merged from the left, and only the two pairs beside it are looked up again. A merge that makes a pair of lower rank gives way
to that pair first, so each piece sees its merges in the very order in which they would come if it were encoded alone. Where
the order can't matter, all places of a rank are merged as arrays.

A text is cut into units where white space follows something else: no piece crosses such a place, and what stands on one side
does not change the other. A unit is split into pieces and encoded when it is first met; texts are then the ids of their units.
Nothing is shuffled. Each Python worker replays the units that are new in a few million characters at a time.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: Characters whose new units are replayed as one corpus, and the most characters of a text that are held as units at a time.
CHUNK = 1 << 22
#: Units remembered between chunks, and pieces replayed as one corpus.
KNOWN, TOGETHER = 400_000, 1 << 16

#: White space, perhaps more than the pattern knows: places that look joined stay joined, which is always right.
_GLUED = re.compile(r"\s ")


class Vocabulary:
    """Token bytes and their ranks, from lines of base64 and rank; and the pairs that merge."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        absent = [b for b in range(256) if bytes([b]) not in self.ranks]
        if absent:
            raise ValueError(f"no token for the bytes {absent}")
        self.octets = [self.ranks[bytes([b])] for b in range(256)]
        #: The value that stands between pieces, and the bits of a token in the key of a pair.
        self.stop = max(self.tokens) + 1
        self.bits = self.stop.bit_length()
        self.merged: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    self.merged[left << self.bits | right] = rank
        #: Tokens of the bytes and then the stop; and what pairs of these merge to (-1: nothing).
        self.first = np.array([*self.octets, self.stop], np.int32)
        self.first_pairs = np.array([[self.merged.get(int(a) << self.bits | int(b), -1) for b in self.first] for a in self.first], np.int32)

    def decoded(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Places of one rank from which on they are merged as arrays.
MANY = 24


def replay(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all pieces, one after the other, and the number of each piece's."""
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    bits, stop, merge = vocabulary.bits, vocabulary.stop, vocabulary.merged.get
    lengths = np.array([len(piece) for piece in pieces], np.int64)
    stops = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(stops[-1]) + 1
    octets = np.full(n, 256, np.int64)
    inside = np.ones(n, bool)
    inside[stops] = False
    octets[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    # Both plain values and arrays look at the same memory.
    tokens, following, before, ranks = (array("i", v.astype(np.int32).tobytes()) for v in (vocabulary.first[octets], np.arange(1, n + 1), np.arange(-1, n - 1), np.append(vocabulary.first_pairs[octets[:-1], octets[1:]], -1)))
    tokens_, following_, before_, ranks_ = (np.frombuffer(v, np.int32) for v in (tokens, following, before, ranks))
    order = np.argsort(ranks_, kind="stable")
    order = order[np.searchsorted(ranks_[order], 0) :]
    there, starts = np.unique(ranks_[order], return_index=True)
    initial = dict(zip(there.tolist(), np.split(order, starts[1:]), strict=False))
    index: dict[int, list[int]] = {rank: [] for rank in initial}
    queue = list(index)
    heapq.heapify(queue)

    def stand(found: int | None, place: int) -> None:
        if found is not None:
            places = index.get(found)
            if places is None:
                index[found] = [place]
                heapq.heappush(queue, found)
            else:
                places.append(place)

    def one_after_the_other(rank: int, places: list[int]) -> None:
        for i, place in enumerate(places):
            if ranks[place] != rank:
                continue
            gone = following[place]
            right, left = following[gone], before[place]
            tokens[place], following[place], before[right], ranks[gone], tokens[gone] = rank, right, place, -1, -1
            ahead, behind = merge(rank << bits | tokens[right]), merge(tokens[left] << bits | rank)
            ranks[place] = -1 if ahead is None else ahead
            ranks[left] = -1 if behind is None else behind
            stand(ahead, place)
            stand(behind, left)
            if (ahead is not None and ahead < rank) or (behind is not None and behind < rank):
                if i + 1 < len(places):
                    index[rank] = places[i + 1 :]
                    heapq.heappush(queue, rank)
                return

    def together(rank: int, places: np.ndarray) -> bool:
        """False, with nothing done, where the order of these merges could matter: neighbours, or a new pair of lower rank."""
        gone = following_[places]
        right, left = following_[gone], before_[places]
        if (right[:-1] >= places[1:]).any():
            return False
        ahead = list(map(merge, (tokens_[right].astype(np.int64) | rank << bits).tolist()))
        behind = list(map(merge, (tokens_[left].astype(np.int64) << bits | rank).tolist()))
        new_ahead, new_behind = (np.array([-1 if r is None else r for r in found], np.int32) for found in (ahead, behind))
        if ((new_ahead >= 0) & (new_ahead < rank)).any() or ((new_behind >= 0) & (new_behind < rank)).any():
            return False
        tokens_[places], following_[places], before_[right], ranks_[gone], tokens_[gone] = rank, right, places, -1, -1
        ranks_[places], ranks_[left] = new_ahead, new_behind
        for found, at in ((ahead, places), (behind, left)):
            for r, place in zip(found, at.tolist(), strict=True):
                if r is not None:
                    stand(r, place)
        return True

    while queue:
        rank = heapq.heappop(queue)
        places, given = index.pop(rank), initial.pop(rank, None)
        if len(places) + (0 if given is None else len(given)) < MANY:
            one_after_the_other(rank, sorted(places if given is None else places + given.tolist()))
            continue
        at = np.array(places, np.int64) if given is None else np.concatenate([given, np.array(places, np.int64)])
        at = np.sort(at[ranks_[at] == rank])
        if not together(rank, at):
            one_after_the_other(rank, at.tolist())
    live = (tokens_ >= 0) & inside
    return tokens_[live], np.diff(np.cumsum(live)[stops])


def segments(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters that begin where a space follows something else (one part if there is no such place)."""
    low = 0
    while len(text) - low > size:
        at = text.find(" ", low + size)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[low:at]
        low = at
    yield text[low:]


def units(segment: str) -> list[str]:
    """What stands before the first space, then what follows each space (which belongs to it) up to the next one that cuts."""
    parts = segment.split(" ")
    if not _GLUED.search(segment):
        return parts
    out: list[str] = []
    for part in parts:
        if out and (not out[-1] or out[-1][-1].isspace()) and len(out) > 1:
            out[-1] += " " + part
        elif out and len(out) == 1 and out[0] and out[0][-1].isspace():
            out[0] += " " + part
        else:
            out.append(part)
    return out


@functools.cache
def newer_characters() -> frozenset[str]:
    """Letters and numbers of the Unicode version of ``regex`` that are neither in the version of the tokenizer library."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = []
    for kind in (r"\p{L}", r"\p{N}"):
        late = [c for c in regex.findall(kind, every) if unicodedata.category(c) == "Cn"]
        # A character of the kind is a piece, for which there is a token; nothing of another is matched.
        ranks = {bytes([b]): b for b in range(256)} | {c.encode(): 256 + i for i, c in enumerate(late)}
        library = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
        found += [c for c in late if not library.encode_ordinary(c)]
    return frozenset(found)


class Encoder:
    """Ids of texts under a vocabulary and a pattern, with the units met so far. The pattern may have white space only alone or as a piece's first space."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, known: int = KNOWN, together: int = TOGETHER):
        self.vocabulary, self.pieces, self.most, self.together = vocabulary, regex.compile(pattern), known, together
        #: Whether letters behind a space are always one piece: that alternative comes before any other but contractions.
        before = pattern.split(r"| ?\p{L}+|")[0]
        self.letters_are_whole = before != pattern and all(a.startswith("'") for a in before.split("|"))
        self.known: dict[str, bytes] = {}
        #: Newer characters are split as the unassigned ones that they are to the library.
        self.newer = newer_characters()
        self.unassigned = str.maketrans(dict.fromkeys(self.newer, "\u0378"))

    def _split(self, unit: str) -> list[str]:
        if not unit.isascii() and not self.newer.isdisjoint(unit):
            return [unit[slice(*m.span())] for m in self.pieces.finditer(unit.translate(self.unassigned))]
        return self.pieces.findall(unit)

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of units given with their space."""
        whole, split = [], {}
        for unit in new:
            if self.letters_are_whole and unit[1:].isalpha() and unit[0] == " ":
                whole.append(unit)
            else:
                split[unit] = self._split(unit)
        met = list({piece for pieces in split.values() for piece in pieces}.union(whole))
        octets = [piece.encode("utf-8") for piece in met]
        ranks = list(map(self.vocabulary.ranks.get, octets))
        todo = [o for o, rank in zip(octets, ranks, strict=True) if rank is None]
        packed, sizes, low = [], [], 0
        while low < len(todo):
            ids, counts = replay(todo[low : low + self.together], self.vocabulary)
            packed.append(ids.astype("<u4").tobytes())
            sizes += counts.tolist()
            low += self.together
        flat, at, of = b"".join(packed), 0, {}
        size = iter(sizes)
        for piece, rank in zip(met, ranks, strict=True):
            if rank is None:
                end = at + 4 * next(size)
                of[piece] = flat[at:end]
                at = end
            else:
                of[piece] = rank.to_bytes(4, "little")
        for unit, pieces in split.items():
            if len(pieces) != 1:
                of[unit] = b"".join(map(of.__getitem__, pieces))
        return of

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text."""
        split = [units(t) for t in texts]
        wanted = set().union(*split)
        new = wanted - self.known.keys()
        learnt = self._learn({" " + u for u in new} | {parts[0] for parts in split})
        known = self.known
        for u in new:
            known[u] = learnt[" " + u]
        out = [b"".join([learnt[parts[0]], *map(known.__getitem__, parts[1:])]) for parts in split]
        if len(known) > self.most:
            self.known = {u: known[u] for u in wanted} if len(wanted) <= self.most else {}
        return out


#: Encoders of this Python worker, by vocabulary and pattern: later tasks find the units of earlier ones.
_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def encoder_of(lines: bytes, pattern: str) -> Encoder:
    name = (sha256(lines).digest(), pattern)
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(Vocabulary(lines), pattern)
    return _ENCODERS[name]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int | None, str]]]:
    held, total = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            said = text.as_py() or ""
            held.append((key.as_py(), said))
            total += len(said)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


COLUMNS = "key bigint, n_tokens bigint, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"


def tokenise(docs: DataFrame, lines: bytes, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True, keep_decoded: bool = False, chunk: int = CHUNK) -> DataFrame:
    """All rows as ``key, n_tokens, ids, decoded, ids_sha256, decoded_sha256``, ids being little-endian 32-bit integers.

    ``lines`` is a rank file (its tokens are the only broadcast; a vocabulary does not grow with the data). ``decoded`` are the bytes
    of the ids' tokens. ``ids`` and ``decoded`` are null unless kept. A null text is empty: no ids. Repeated rows stay, an empty table gives an empty result, other columns
    are ignored. A text of any length is worked on in parts of ``chunk`` characters.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value, pattern)
        for rows in _chunks(batches, chunk):
            out = []
            parts = [list(segments(t, chunk)) for _, t in rows]
            short = iter(encoder.encode([p[0] for p in parts if len(p) == 1]))
            for (name, _), pieces in zip(rows, parts, strict=True):
                n, hashed, spelt, ids, decoded = 0, sha256(), sha256(), [], []
                for packed in [next(short)] if len(pieces) == 1 else (encoder.encode([p])[0] for p in pieces):
                    said = encoder.vocabulary.decoded(packed)
                    n += len(packed) // 4
                    hashed.update(packed)
                    spelt.update(said)
                    if keep_ids:
                        ids.append(packed)
                    if keep_decoded:
                        decoded.append(said)
                out.append((name, n, b"".join(ids) if keep_ids else None, b"".join(decoded) if keep_decoded else None, hashed.hexdigest(), spelt.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, COLUMNS)
