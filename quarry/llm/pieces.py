"""Token ids of whole texts from the ids of their distinct pieces.

Byte-level tokenizers handle every match of their pattern alone, so a batch is
cut into pieces, each distinct piece is encoded once, and ids are gathered by
piece. Texts with characters on which Unicode tables may differ, or with the
content of an added token of the vocabulary, are encoded whole by the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.kernels import U64, pair_hash, spread, split_pieces, string_buffers, text_chunks

#: Distinct pieces a worker remembers, the first it meets; all others are encoded once a chunk. It changes no result.
MEMO_PIECES = 1 << 20
#: Those of them that don't fit a key of KEY_BYTES and are remembered as strings, and the longest of these.
LONG_PIECES, MEMO_BYTES = 1 << 16, 64
#: Longest piece, in bytes, that its key holds whole.
KEY_BYTES = 15
#: Bytes of text cut into pieces at once.
PIECE_CHUNK = 1 << 20
#: Pieces given to the library in one call.
CALL_PIECES = 1 << 12


def piece_keys(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and length of pieces of at most KEY_BYTES as two 64-bit words, which no two pieces share."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    kept = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    return words[begins] & kept[np.minimum(sizes, 8)], words[begins + 8 * (sizes > 8)] & kept[np.maximum(sizes - 8, 0)] | sizes.astype(U64) << U64(56)


class PieceMemory:
    """Ids of pieces in flat arrays; a table of open addressing over exact keys tells a piece's place, without an object for each piece."""

    def __init__(self, most: int):
        self.most, self.known, self.n_ids = most, 0, 0
        self.slots = np.full(1 << 10, -1, np.int32)
        self.low, self.high = np.zeros(0, U64), np.zeros(0, U64)
        self.begins, self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.long: dict[str, int] = {}

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (pair_hash(low, high) & U64(len(self.slots) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for unknown ones."""
        out, todo, at = np.full(len(low), -1, np.int64), np.arange(len(low)), self._first(low, high)
        while len(todo):
            place = self.slots[at]
            used = place >= 0
            todo, at, place = todo[used], at[used], place[used]
            same = (self.low[place] == low[todo]) & (self.high[place] == high[todo])
            out[todo[same]] = place[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out

    def _enter(self, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        todo, at = np.arange(len(low)), self._first(low, high)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[todo[free]]
            lost = self.slots[at] != places[todo]  # to what was there, or to another that came here too
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _grown(x: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        """The array with what is added after its used part, in twice the room where it has none."""
        if used + len(more) > len(x):
            x = np.concatenate([x[:used], np.zeros(max(used + 2 * len(more), 1 << 10), x.dtype)])
        x[used : used + len(more)] = more
        return x

    def add(self, low: np.ndarray, high: np.ndarray, long: list[str | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers different new pieces by their keys, or by themselves where `long` has them."""
        begins = self.n_ids + np.cumsum(sizes) - sizes
        places = np.arange(self.known, self.known + len(sizes), dtype=np.int32)
        self.begins, self.sizes = self._grown(self.begins, self.known, begins), self._grown(self.sizes, self.known, sizes)
        self.low, self.high = self._grown(self.low, self.known, low), self._grown(self.high, self.known, high)
        self.flat = self._grown(self.flat, self.n_ids, ids)
        self.known, self.n_ids = self.known + len(sizes), self.n_ids + len(ids)
        short = np.fromiter((p is None for p in long), bool, len(long))
        self.long.update((long[k], int(places[k])) for k in np.flatnonzero(~short))
        if 2 * self.known > len(self.slots):
            self.slots = np.full(1 << (2 * self.known - 1).bit_length(), -1, np.int32)
            every = np.arange(self.known, dtype=np.int32)
            every = every[self.high[: self.known] != 0]
            self._enter(self.low[every], self.high[every], every)
        else:
            self._enter(low[short], high[short], places[short])


class PieceEncoder:
    """Encodes batches with `encode_pieces` (distinct pieces to all their ids and the number of each) and `encode_text` (odd texts, and texts that hold any of `whole`)."""

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_text: Callable[[str], list[int]], whole: list[bytes] = (), remember: int = MEMO_PIECES):
        self.encode_pieces, self.encode_text, self.whole = encode_pieces, encode_text, whole
        self.memory = PieceMemory(remember)

    def _ids_of(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each of different pieces, where they begin, all their ids), from memory or made now."""
        data, offsets = string_buffers(pieces)
        lengths, memory = np.diff(offsets), self.memory
        low, high = np.zeros(len(lengths), U64), np.zeros(len(lengths), U64)
        short, long = np.flatnonzero(lengths <= KEY_BYTES), np.flatnonzero(lengths > KEY_BYTES)
        low[short], high[short] = piece_keys(data, offsets[short], lengths[short])
        places = np.full(len(lengths), -1, np.int64)
        places[short] = memory.find(low[short], high[short])
        places[long] = [memory.long.get(p, -1) for p in pieces.take(pa.array(long)).to_pylist()]
        known, missing = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        sizes, begins, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), places[known]
        sizes[known] = memory.sizes[at]
        begins[known] = np.cumsum(sizes[known]) - sizes[known]
        ids = memory.flat[spread(np.arange(len(at)), sizes[known], memory.begins[at].astype(np.int64))]
        if not len(missing):
            return sizes, begins, ids
        new = pieces.take(pa.array(missing)).to_pylist()
        more, n = self.encode_pieces(new)
        first = np.cumsum(n) - n
        sizes[missing], begins[missing] = n, len(ids) + first
        keep = lengths[missing] <= KEY_BYTES
        few = np.flatnonzero(~keep & (lengths[missing] <= MEMO_BYTES))[: max(0, LONG_PIECES - len(memory.long))]
        keep[few] = True
        kept = np.flatnonzero(keep)[: max(0, memory.most - memory.known)]
        if len(kept):
            own = missing[kept]
            memory.add(low[own], high[own], [None if lengths[k] <= KEY_BYTES else new[j] for j, k in zip(kept, own)], n[kept], more[spread(kept, n, first)])
        return sizes, begins, np.concatenate([ids, more])

    def encode_parts(self, column: pa.Array | pa.ChunkedArray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each text) for runs of texts of about `chunk` bytes, so that neither working memory nor ids grow with the batch."""
        data, offsets = string_buffers(column)
        for a, b in text_chunks(offsets, chunk):
            lo, hi = int(offsets[a]), int(offsets[b])
            yield self._chunk(data[lo:hi], offsets[a : b + 1] - lo)

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column in order, and the first id of each text (texts + 1)."""
        data, offsets = string_buffers(column)
        ids, counts = [], np.zeros(len(offsets), np.int64)
        for a, b in text_chunks(offsets, PIECE_CHUNK):
            lo, hi = int(offsets[a]), int(offsets[b])
            got, n = self._chunk(data[lo:hi], offsets[a : b + 1] - lo)
            ids.append(got)
            counts[a + 1 : b + 1] = n
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.cumsum(counts)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, odd = split_pieces(data, offsets)
        odd |= self._holding(data, offsets)
        if odd.any():  # few: the library takes these texts whole, the rest go on without them
            keep = np.repeat(~odd, np.diff(offsets))
            sizes = np.where(odd, 0, np.diff(offsets))
            ids, n = self._chunk(data[keep], np.concatenate([[0], np.cumsum(sizes)]))
            parts = np.split(ids, np.cumsum(n)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = np.asarray(self.encode_text(data[offsets[k] : offsets[k + 1]].tobytes().decode()), np.uint32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        sizes, begins, flat = self._ids_of(coded.dictionary)
        codes = coded.indices.to_numpy()
        ids = flat[spread(codes, sizes, begins)]
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        n = np.diff(total[np.searchsorted(starts, offsets)])
        return ids, n

    def _holding(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold one of the byte strings that only the whole text's encoder knows."""
        out = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes() if self.whole else b""
        for x in self.whole:
            at = raw.find(x)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                out[k] |= at + len(x) <= offsets[k + 1]
                at = raw.find(x, at + 1)
        return out


_LIBRARY: dict[tuple[str, int], PieceEncoder] = {}


def library_encoder(path: str, remember: int = MEMO_PIECES) -> PieceEncoder:
    """This worker's encoder for a byte-level vocabulary of the tokenizers library, with room for some pieces."""
    if (path, remember) not in _LIBRARY:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        n_bytes = np.zeros(tok.get_vocab_size() + 1, np.int64)  # of each id: its string has a character a byte
        for token, k in tok.get_vocab(with_added_tokens=False).items():
            n_bytes[k] = len(token)

        def encode_call(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # one row of words that are cut already: the library keeps to their borders, at which ids' bytes end
            ids = np.array(tok.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends, at = np.cumsum([len(p.encode()) for p in pieces]), np.cumsum(n_bytes[ids])
            last = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[last] == ends).all():
                return ids, np.diff(last, prepend=-1)
            e = tok.encode_batch([pieces], is_pretokenized=True, add_special_tokens=False)[0]  # some bytes have no id
            return np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces))

        def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [encode_call(pieces[k : k + CALL_PIECES]) for k in range(0, len(pieces), CALL_PIECES)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

        _LIBRARY[path, remember] = PieceEncoder(encode_pieces, lambda text: tok.encode(text, add_special_tokens=False).ids, [t.content.encode() for t in tok.get_added_tokens_decoder().values() if t.content], remember)
    return _LIBRARY[path, remember]
