"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's own rule: at each place the longest prefix in the compiled character map is replaced by
its mapping, else one character is copied; spaces become U+2581, one is put in front, runs are trimmed if the model says
so. Normalising records, for each normalised byte, the original byte where its character or prefix starts. The normalised
text is then merged into pieces by this module's own byte-pair encoder, the best-scored neighbours first, and each piece is
projected to a span of original bytes by what normalising recorded. A character that is no piece becomes its bytes, where the
model has them (the last of which takes the character's whole span), else the unknown id.

No piece of a usual model has U+2581 after another character, so what starts with U+2581 is encoded on its own and remembered;
where a model has such pieces, whole texts are merged at once. Words that are not remembered are merged together, a batch's at
once: a row of symbols each, one merge a step, in numpy. Decoding is the library's.

Defined cases: null counts as the empty text, which has no ids; lone surrogates cannot reach here from Spark; texts of any
length are encoded whole, and words of any length (by a heap, so in n log n steps); repeated rows each give a row; neighbours
with equal scores merge from the left; empty tables give no rows; extra columns, whatever their names, are ignored. Models
that are not byte-pair models, or have user-defined symbols, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import common

_SPACE = "▁"
#: A model's kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE, BPE = 1, 2, 3, 4, 5, 6, 2
#: Characters from which a part is merged on its own, words remembered, and words of texts that are encoded at once.
SHORT, REMEMBERED, AT_ONCE = 24, 150_000, 400_000
_NONE = 1 << 40
_NEVER = float("-inf")


def _packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


class CharMap:
    """The compiled map: a double-array trie of prefixes and a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.values = np.empty(0, np.uint32), b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.values = blob[4 + size :]
        starts = sorted(self._starts())
        self.some = re.compile("[" + "".join(map(re.escape, starts)) + "]") if starts else None

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """(unit, its children's base) of the child that `byte` leads to."""
        at = node ^ byte
        unit = int(self.units[at]) if at < len(self.units) else 0x80000000
        return (unit, at ^ (unit >> 10) << ((unit & 0x200) >> 6)) if unit & 0x800000FF == byte else None

    def _root(self) -> int:
        unit = int(self.units[0])
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _starts(self) -> Iterator[str]:
        """Characters that a prefix in the map starts with."""
        waiting = [(b"", self._root())] if len(self.units) else []
        while waiting:
            key, node = waiting.pop()
            for byte in range(1, 256):
                if (found := self._step(node, byte)) is not None:
                    longer = key + bytes([byte])
                    if len(longer) == _char_size(longer[0]):
                        yield longer.decode()
                    else:
                        waiting.append((longer, found[1]))

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of raw[at:] in the map, and its replacement."""
        if not len(self.units):
            return None
        node, best = self._root(), None
        for i in range(at, len(raw)):
            if (found := self._step(node, raw[i])) is None:
                break
            unit, node = found
            if unit >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                best = (i + 1 - at, self.values[value : self.values.index(b"\0", value)])
        return best


def _char_size(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _char_starts(raw: bytes, first: int) -> np.ndarray:
    """For each byte, the place where its character starts, counted from `first`."""
    at = np.arange(first, first + len(raw))
    return np.maximum.accumulate(np.where(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80, at, 0))


class Codec:
    """A model's normaliser with alignment, its byte-pair encoder, and the library's decoder."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(blob)
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE or USER_DEFINED in kinds:
            raise ValueError("only byte-pair models without user-defined symbols are encoded")
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.unused = {p.piece for p in model.pieces if p.type == UNUSED}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE} if model.trainer_spec.byte_fallback else {}
        self.sizes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        # two characters that stand side by side in no piece are never merged
        self.side_by_side = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self._merge_tables(model)
        inside = any(_SPACE in p.lstrip(_SPACE) for p in self.scores)
        self.word = re.compile(r"(?s).+" if inside else f"(?s){_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)

    def _mapped(self, text: str, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text after the map; for each byte its origin, and where its character or replacement starts, or -1 for what comes
        after a replacement's leading blanks."""
        parts, origins, heads, at, done, size = [], [], [], 0, 0, 0
        place = 0  # bytes before character `done`
        for found in self.map.some.finditer(text) if self.map.some else ():
            if found.start() < done:
                continue
            place += len(text[done : found.start()].encode())
            hit = self.map.longest(raw, place)
            done = found.start()
            if hit is None:
                continue
            step, new = hit
            parts += [raw[at:place], new]
            origins += [_char_starts(raw[at:place], at), np.full(len(new), place)]
            heads += [np.arange(size, size + place - at), np.full(len(new), -1)]
            size += place - at
            heads[-1][: len(new) - len(new.lstrip(b" "))] = size
            size += len(new)
            done += len(raw[place : place + step].decode())
            at = place = place + step
        parts.append(raw[at:])
        origins.append(_char_starts(raw[at:], at))
        heads.append(np.arange(size, size + len(raw) - at))
        return b"".join(parts), np.concatenate(origins), np.concatenate(heads)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the original byte where it starts."""
        raw = text.encode("utf-8", "surrogatepass")
        out, origin, head = self._mapped(text, raw)
        begin, end, blank = 0, len(raw), np.frombuffer(out, np.uint8) == 32
        if self.trim:
            while begin < len(raw) and (found := self.map.longest(raw, begin) or (1, raw[begin : begin + 1]))[1] == b" ":
                begin += found[0]
            solid = np.flatnonzero(~blank)
            if not len(solid):
                return b"", np.array([end])
            # blanks that follow a blank go, but not those that a replacement has inside
            keep = ~blank | (head < 0) | ~np.concatenate(([True], blank[:-1]))[head]
            keep[: solid[0]] = False
            out, origin, blank = np.frombuffer(out, np.uint8)[keep].tobytes(), origin[keep], blank[keep]
        space = _SPACE.encode() if self.escape else b" "
        if self.dummy_prefix and raw and not self.suffix:
            out, origin, blank = b" " + out, np.concatenate(([begin], origin)), np.concatenate(([True], blank))
        origin = np.repeat(origin, np.where(blank, len(space), 1))
        out = out.replace(b" ", space)
        while self.trim and out.endswith(space):
            out, end, origin = out[: -len(space)], int(origin[-len(space)]), origin[: -len(space)]
        if self.dummy_prefix and raw and self.suffix:
            out, origin = out + space, np.concatenate((origin, np.full(len(space), end)))
        return out, np.concatenate((origin, [end]))

    def pieces(self, part: str) -> list[str]:
        """Merges the characters of a part, the neighbours with the best score first, from the left where scores are equal."""
        made: dict[str, tuple[str, str]] = {}
        out = (self._by_scan if len(part) <= SHORT else self._by_heap)(part, made)
        while self.unused and any(s in self.unused and s in made for s in out):
            out = [x for s in out for x in (made[s] if s in self.unused and s in made else (s,))]
        return out

    def _by_scan(self, part: str, made: dict[str, tuple[str, str]]) -> list[str]:
        """Few symbols: the best pair is looked up among all of them each time."""
        score, symbols, unused = self.scores.get, list(part), self.unused
        pairs = [score(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) > _NEVER:
            i = pairs.index(best)
            pair = symbols[i] + symbols[i + 1]
            if unused and pair in unused:
                made[pair] = (symbols[i], symbols[i + 1])
            symbols[i : i + 2] = [pair]
            del pairs[i]
            if i:
                pairs[i - 1] = score(symbols[i - 1] + pair, _NEVER)
            if i < len(pairs):
                pairs[i] = score(pair + symbols[i + 1], _NEVER)
        return symbols

    def _by_heap(self, part: str, made: dict[str, tuple[str, str]]) -> list[str]:
        scores, symbols = self.scores, list(part)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap = [(-scores[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in scores]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            if pair in self.unused:
                made[pair] = (symbols[i], symbols[j])
            symbols[i], symbols[j], after[i] = pair, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (new := pair + symbols[after[i]]) in scores:
                    heapq.heappush(heap, (-scores[new], i, new))
            if before[i] >= 0 and (new := symbols[before[i]] + pair) in scores:
                heapq.heappush(heap, (-scores[new], before[i], new))
        return [s for s in symbols if s]

    def _encoded_part(self, part: str) -> tuple[int, ...]:
        """ids; an unknown piece of n normalised bytes is -n."""
        pieces = self.pieces(part) if len(part) > 1 else [part]
        found = tuple(map(self.ids.get, pieces))
        if None not in found:
            return found
        out: list[int] = []
        for piece, known in zip(pieces, found):
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(-len(piece.encode()))
        return tuple(out)

    def _merge_tables(self, model) -> None:
        """Symbols as numbers: a piece's id, from len(pieces) on characters that only occur inside pieces. merges: sorted pairs of
        symbols that are a piece together, its rank by score and its id."""
        self.extra = sorted({c for p in self.scores for c in p if c not in self.ids})
        number = self.ids | {c: len(model.pieces) + i for i, c in enumerate(self.extra)}
        rank = {v: i for i, v in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = sorted({(number[p[:i]] << 32 | number[p[i:]], rank[v], self.ids[p]) for p, v in self.scores.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number})
        self.merges = tuple(np.array([x[i] for x in pairs], np.int64) for i in range(3))
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int64)  # other characters
        for c, i in number.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.beside = np.array(sorted(ord(x[0]) << 32 | ord(x[1]) for x in self.side_by_side), np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that two symbols are together (_NONE: there is none), and its id."""
        keys, ranks, ids = self.merges
        key = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], _NONE), ids[at]

    def _merged(self, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """rows: `size` symbols each. The symbols left of each row after all merges, from the left, and their number."""
        rows, count, live = rows.copy(), np.full(len(rows), size), np.arange(len(rows))
        rank, made = self._looked_up(rows[:, :-1], rows[:, 1:])
        column = np.arange(size)
        while True:
            best = rank[live].argmin(1)  # the leftmost of the best
            some = rank[live, best] < _NONE
            live, best = live[some], best[some]
            if not len(live):
                return rows, count
            new = made[live, best]
            follow = np.minimum(column + (column > best[:, None]), size - 1)  # what is right of the pair moves to the left
            rows[live] = np.take_along_axis(rows[live], follow, 1)
            rows[live, best] = new
            rank[live], made[live] = (np.take_along_axis(x[live], follow[:, :-1].clip(max=size - 2), 1) for x in (rank, made))
            count[live] -= 1
            for at in (best - 1, best):
                ok = (at >= 0) & (at + 1 < count[live])
                r, c = live[ok], at[ok]
                rank[r, c], made[r, c] = self._looked_up(rows[r, c], rows[r, c + 1])
            rank[live, count[live] - 1 if size > 1 else 0] = _NONE  # behind the last symbol

    def learn(self, words: list[str]) -> None:
        """Puts words that are not known yet into `known`."""
        found = [w for w in dict.fromkeys(words) if w not in self.known]
        known = [w for w in found if w in self.older]
        self.known.update((w, self.older[w]) for w in known)
        words = [w for w in found if w not in self.known]
        if len(self.known) + len(words) > REMEMBERED:  # what is used again is found among the older ones and kept again
            self.older, self.known = self.known, {w: self.known[w] for w in known}
        if self.unused or not len(self.merges[0]):
            self.known.update((w, _packed(self._encoded_part(w))) for w in words)
        elif words:
            self.known.update(zip(words, self._together(words)))

    def _together(self, words: list[str]) -> list[bytes]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        # no merge crosses from a word to the next, or between characters that are side by side in no piece
        pair = codes[:-1] << 32 | codes[1:]
        joined = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] == pair
        joined[ends[:-1] - 1] = False
        cuts = np.flatnonzero(~joined) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(codes)]))
        size, symbols = stops - starts, self.symbol_of[codes]
        left, gone = np.ones(len(starts), np.int64), np.zeros(len(codes), bool)  # symbols left of each part; characters without one
        for n in np.unique(size[size > 1]).tolist():
            at = np.flatnonzero(size == n)
            if n > SHORT:
                for i in at.tolist():
                    ids = [self.ids.get(p, -1) if len(p) > 1 else int(self.symbol_of[ord(p)]) for p in self.pieces("".join(map(chr, codes[starts[i] : stops[i]].tolist())))]
                    symbols[starts[i] : starts[i] + len(ids)], left[i] = ids, len(ids)
                    gone[starts[i] + len(ids) : stops[i]] = True
                continue
            place = starts[at][:, None] + np.arange(n)
            symbols[place], left[at] = self._merged(symbols[place], n)
            gone[place] = np.arange(n) >= left[at][:, None]
        # symbols that are no pieces become bytes, or unknown ones
        kept = symbols[~gone]
        bounds = np.concatenate(([0], np.cumsum(~gone)[ends - 1]))
        raw, of_word = kept.astype(np.int32).tobytes(), (4 * bounds).tolist()
        out = [raw[a:b] for a, b in zip(of_word, of_word[1:])]
        odd = np.flatnonzero((kept < 0) | (kept >= len(self.sizes)))
        for w in np.unique(np.searchsorted(bounds, odd, side="right") - 1).tolist():
            out[w] = _packed([i for x in kept[bounds[w] : bounds[w + 1]].tolist() for i in self._plain(x)])
        return out

    def _plain(self, symbol: int) -> tuple[int, ...]:
        """ids of a symbol; an unknown one of n bytes is -n."""
        if 0 <= symbol < len(self.sizes):
            return (symbol,)
        raw = (chr(-1 - symbol) if symbol < 0 else self.extra[symbol - len(self.sizes)]).encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw) if self.byte_ids else (-len(raw),)

    def words_of(self, text: str | None) -> tuple[list[str], list[bytes | None], np.ndarray]:
        """The normalised text in words, what is known of them, and the original byte where each normalised byte starts."""
        normal, origin = self.normalise(text) if text else (b"", np.zeros(1, np.int64))
        words = self.word.findall(normal.decode("utf-8", "surrogatepass"))
        return words, list(map(self.known.get, words)), origin

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Of each text: ids, and the original byte where each piece starts and ends."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(self.words_of(text))
            held += len(waiting[-1][0])
            if held > AT_ONCE:
                yield from self._encoded(waiting)
                waiting, held = [], 0
        yield from self._encoded(waiting)

    def _encoded(self, waiting: list[tuple[list[str], list[bytes | None], np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        self.learn([w for words, got, _ in waiting for w, g in zip(words, got) if g is None])
        for words, got, origin in waiting:
            if None in got:
                got = [g or self.known[w] for w, g in zip(words, got)]
            ids = np.frombuffer(b"".join(got), np.int32)
            sizes = self.sizes[ids]
            if not self.byte_ids and (unknown := ids < 0).any():  # neighbouring unknown pieces are one
                sizes = np.where(unknown, -ids, sizes)
                first = np.flatnonzero(~(unknown & np.concatenate(([False], unknown[:-1]))))
                ids, sizes = np.where(unknown, self.unknown, ids)[first], np.add.reduceat(sizes, first)
            ends = np.cumsum(sizes)
            yield ids.tolist(), origin[ends - sizes], origin[ends]

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids) if ids else ""


_codecs: dict[bytes, Codec] = {}


def codec(blob: bytes) -> Codec:
    """One for each model in a worker process."""
    key = hashlib.sha256(blob).digest()
    if key not in _codecs:
        _codecs[key] = Codec(blob)
    return _codecs[key]


def _model(docs: DataFrame, model_file: str) -> Broadcast:
    """The model's bytes, read where the driver is: executors need not have the file. Models are a few MB, whatever the input."""
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, starts, ends (spans of original bytes)."""
    blob = _model(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(blob.value)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                rows = list(use.encode_all(batch.column(1).to_pylist()))
                columns = [pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "ids", "starts", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<bigint>, ends array<bigint>")


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    blob = _model(rows, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(blob.value)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                yield pa.record_batch([batch.column(0), pa.array([use.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.bounded(rows.select("doc_id", "ids")).mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document, in one pass over encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes."""
    blob = _model(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(blob.value)
        said = [str(i) for i in range(len(use.sizes))]
        for batch in batches:
            out = []
            for ids, starts, ends in use.encode_all(batch.column(1).to_pylist()):
                back = use.decode(ids)
                out.append((len(ids), hashlib.sha256(",".join([said[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int((ends - starts).sum())))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spanned_bytes bigint")
