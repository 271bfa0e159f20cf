"""Byte-level BPE by a finite-state transducer that is determinised as it is needed.

The encoding of a text that ends in token t is the encoding of the text before t followed
by t, and a sequence is an encoding when each two neighbours, merged on their own, stay the
same two tokens. So the last token of every prefix is unique, and the
tokens of a prefix follow from the last tokens of earlier prefixes. A state of the
transducer holds the prefixes that a coming token may still start at: for each, the bytes
read since (a proper beginning of some token) and the tokens that lead to it. What all of
them share is settled and is emitted; no state looks back further than the longest token.
Most pieces of a usual text are short and met once in a worker, so states that hold tokens
would not be used again. For pieces of up to ``SHORT`` bytes a state holds only the beginnings,
which other pieces meet again, and the last tokens of all prefixes are kept beside it.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from struct import pack as _packed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SHORT = 40  # bytes of a piece whose states hold no tokens; there they would cost more than they save


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Tokens of a piece by the merges themselves: again and again, the leftmost pair of
    the lowest rank (``below`` a rank). Used for single tokens, which are short."""
    parts, never = [piece[i: i + 1] for i in range(len(piece))], len(ranks) + (1 << 40)
    pairs = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == never or below is not None and least >= below:
            break
        i = pairs.index(least)
        both = parts[i] + parts.pop(i + 1)
        parts[i] = both
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + both, never)
        if i < len(pairs):
            pairs[i] = ranks.get(both + parts[i + 1], never)
    return parts


def merged_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece by the merges: what the transducer has to give."""
    return [ranks[part] for part in merged(piece, ranks)]


class Transducer:
    """``encode`` gives the token ids of a piece, ``encode_short`` those of a piece of which all
    last tokens may be kept; states and arcs are made when first met.

    At most ``max_states`` states of each kind and ``max_pairs`` pair checks are kept; beyond
    that they are forgotten and made anew, which changes no result.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pairs: int = 1_000_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]  # of the trie of tokens
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = rank
        size = max(self.tokens, default=-1) + 1
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(size)]
        self.spines: dict[tuple[int, int], list[int] | None] = {}
        self.unknown: dict[int, bool] = {}  # of all tokens that no pair check has met; stays empty
        self.after = [self.unknown] * (size + 1)  # per token, and last for the begin: which may follow
        self.n_pairs = 0
        self._clear()
        self._clear_short()

    def _clear(self) -> None:
        self.keys: list[tuple] = []
        self.places: dict[tuple, int] = {}
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._state((-1, ((0, ()),)))

    def _state(self, key: tuple) -> int:
        place = self.places.get(key)
        if place is None:
            place = self.places[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        return place

    def _spine(self, token: int, side: int) -> list[int] | None:
        """What the first (side 0) or last (side 1) byte of a token is part of, from that
        byte to the token, as the merges go; None if merges don't lead to the token."""
        key = (token, side)
        if key not in self.spines:
            whole = self.tokens[token]
            if len(whole) == 1:
                self.spines[key] = [token]
            else:
                parts = merged(whole, self.ranks, below=token)
                for end in (0, 1):
                    before = [self._spine(self.ranks[x], end) for x in parts] if len(parts) == 2 else [None]
                    self.spines[token, end] = None if None in before else [*before[-end], token]
        return self.spines[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may come after ``left`` (or first, if that is -1).

        What meets at the border of the two changes as each side merges, in rising rank;
        they stay apart if what meets is never a token of lower rank than the next merge
        on either side (at equal rank the merge further left is made first).
        """
        known = self.after[left].get(right)
        if known is None:
            if self.n_pairs >= self.max_pairs:
                self.after[:] = [self.unknown] * len(self.after)
                self.n_pairs = 0
            if self.after[left] is self.unknown:
                self.after[left] = {}
            known = self.after[left][right] = self._apart(left, right)
            self.n_pairs += 1
        return known

    def _apart(self, left: int, right: int) -> bool:
        second = self._spine(right, 0)
        if second is None or left < 0:
            return second is not None
        first, i, j, never = self._spine(left, 1), 0, 0, len(self.ranks) + 1
        if first is None:
            return False
        while True:
            met = self.ranks.get(self.tokens[first[i]] + self.tokens[second[j]], never)
            next_first = first[i + 1] if i + 1 < len(first) else never
            next_second = second[j + 1] if j + 1 < len(second) else never
            if met < next_first and met <= next_second and met < never:
                return False
            if next_first == next_second == never:
                return True
            if next_first <= next_second:
                i += 1
            else:
                j += 1

    def _step(self, place: int, byte: int) -> tuple[int, tuple[int, ...]]:
        settled, open_ = self.keys[place]
        children, token_at, after = self.children, self.token_at, self.after
        live, end = [], None
        for node, path in open_:
            node = children[node].get(byte)
            if node is None:
                continue
            if end is None:
                token = token_at[node]
                if token >= 0:
                    before = path[-1] if path else settled
                    fits = after[before].get(token)
                    if self.follows(before, token) if fits is None else fits:
                        end = (*path, token)
            if children[node]:
                live.append((node, path))
        if end is None:
            raise ValueError(f"byte {byte} cannot be encoded with these ranks")
        live.append((0, end))
        shared = 0
        if live[0][1]:
            while all(len(path) > shared and path[shared] == end[shared] for _, path in live):
                shared += 1
        if not shared:
            return self._state((settled, tuple(live))), ()
        live = tuple([(node, path[shared:]) for node, path in live])
        return self._state((end[shared - 1], live)), end[:shared]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token stays whole, as the library has it
            return [whole]
        if len(self.keys) > self.max_states:
            self._clear()
        ids, place = [], 0
        for byte in piece:
            arc = self.arcs[place].get(byte)
            if arc is None:
                arc = self.arcs[place][byte] = self._step(place, byte)
            place, emitted = arc
            ids += emitted
        return [*ids, *self.keys[place][1][-1][1]]

    def _clear_short(self) -> None:
        self.short: dict[tuple[int, ...], dict] = {}
        self.first = self._short_state(())

    def _short_state(self, nodes: tuple[int, ...]) -> dict:
        """The arcs of a state: per byte the next state's arcs, the tokens of several bytes that
        end there, longest first, each with minus its length, and the token of the byte (or -1).
        Under None it has the beginnings that a coming byte may continue."""
        arcs = self.short.get(nodes)
        if arcs is None:
            arcs = self.short[nodes] = {None: nodes}
        return arcs

    def _short_arc(self, arcs: dict, byte: int) -> tuple[dict, tuple[tuple[int, int], ...], int]:
        live, ends, single = [], [], -1
        for node in (*arcs[None], 0):
            node = self.children[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and self.sizes[token] == 1:
                single = token
            elif token >= 0:
                ends.append((token, -self.sizes[token]))
            if self.children[node]:
                live.append(node)
        arc = arcs[byte] = (self._short_state(tuple(live)), tuple(ends), single)
        return arc

    def encode_short(self, piece: bytes) -> list[int]:
        """The last token of every prefix; those of the piece follow from its end. Of all tokens
        that end at a byte just one fits, so the byte's own needs no check when no other does."""
        if len(self.short) > self.max_states:
            self._clear_short()
        last, arcs, after = [-1], self.first, self.after
        for byte in piece:
            try:
                arcs, ends, single = arcs[byte]
            except KeyError:
                arcs, ends, single = self._short_arc(arcs, byte)
            for token, back in ends:
                before = last[back]
                try:
                    fits = after[before][token]
                except KeyError:
                    fits = self.follows(before, token)
                if fits:
                    last.append(token)
                    break
            else:
                if single < 0:
                    raise ValueError(f"byte {byte} cannot be encoded with these ranks")
                last.append(single)
        ids, sizes, at = [], self.sizes, len(piece)
        while at:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids


class Utf8Decoder:
    """Incremental UTF-8: bytes in pieces of any size, characters out as soon as they are
    whole. The state is the begun character, three bytes at most; what cannot be part of a
    character becomes U+FFFD."""

    def __init__(self):
        self.begun = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end of ``data`` that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
                if need <= back:
                    return 0
                second = data[-back + 1] if back > 1 else None
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                return back if second is None or low <= second <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        keep = self._open(data)
        self.begun = data[len(data) - keep:] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of whole texts. What words of a text become is remembered, as
    little-endian unsigned 32-bit integers; beyond ``most`` entries it is made anew."""

    def __init__(self, path: str, pattern: str, most: int = 500_000):
        import regex

        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks, min(200_000, most), 2 * most)
        self.tokens = self.transducer.tokens
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most
        # A single space, or newline, between two characters that are not white space
        # starts a match of the usual pattern; only then a text is looked up by words.
        self.by_words = pattern == _usual_pattern()
        # White space of the pattern, and all but the last of a run of it.
        self.blank = re.compile(r"[^\S\x1c-\x1f]+\Z").search
        self.runs = re.compile(r"([^\S\x1c-\x1f]+(?=[^\S\x1c-\x1f]))").split
        size = max(self.tokens, default=-1) + 1
        self.table = pa.array([self.tokens.get(i, b"") for i in range(size)], pa.large_binary())

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            data = piece.encode()
            whole = self.ranks.get(data)
            coded = [whole] if whole is not None else self.transducer.encode_short(data) if len(data) <= SHORT else self.transducer.encode(data)
            ids = self.pieces[piece] = _packed("<%dI" % len(coded), *coded)
        return ids

    def _word(self, word: str) -> bytes:
        """A word after a space; one that begins with a newline has no space before it."""
        if len(self.words) >= self.most:
            self.words.clear()
        text = word if word[0] == "\n" else " " + word
        ids = self.words[word] = b"".join([self._piece(p) for p in self.split(text)])
        return ids

    def encode(self, text: str) -> bytes:
        if not text or not self.by_words:
            return b"".join([self._piece(p) for p in self.split(text)])
        # White space at the end is one match. Elsewhere all but the last of a run of it is
        # one, and what the last begins is as if the text began there.
        end = self.blank(text) if text[-1].isspace() else None
        parts = self.runs(text if end is None else text[: end.start()])
        out, known, word = [], self.words.get, self._word
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self._piece(part))
                continue
            first, *words = part.replace("\n", " \n").split(" ")
            if first:
                out += [self._piece(p) for p in self.split(first)]
            out += [known(w) or word(w) for w in words]
        if end is not None:
            out.append(self._piece(end.group()))
        return b"".join(out)

    def token_bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all tokens, one after the other, and where each begins and the last ends."""
        taken = self.table.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
        body = taken.buffers()[2]
        return (body.to_pybytes()[: offsets[-1]] if body is not None else b""), offsets

    def decode_all(self, raws: list[bytes], most: int = 1 << 22) -> Iterator[bytes]:
        """The text of each list of ids, in UTF-8, by the incremental decoder. The tokens of
        about ``most`` bytes of ids are looked up at once; longer lists go through in chunks."""
        at = 0
        while at < len(raws):
            if len(raws[at]) > most:
                yield "".join(self.decode_stream(np.frombuffer(raws[at], "<u4"))).encode()
                at += 1
                continue
            stop, size = at + 1, len(raws[at])
            while stop < len(raws) and size + len(raws[stop]) <= most:
                size += len(raws[stop])
                stop += 1
            data, offsets = self.token_bytes(np.frombuffer(b"".join(raws[at:stop]), "<u4"))
            ends = offsets[np.cumsum([len(raw) // 4 for raw in raws[at:stop]])].tolist()
            for begin, end in zip([0, *ends], ends, strict=False):
                decoder = Utf8Decoder()
                yield (decoder.feed(data[begin:end]) + decoder.close()).encode()
            at = stop

    def decode_stream(self, ids: np.ndarray, chunk: int = 65_536) -> Iterator[str]:
        decoder = Utf8Decoder()
        for i in range(0, len(ids), chunk):
            yield decoder.feed(self.token_bytes(ids[i: i + chunk])[0])
        yield decoder.close()


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, most: int) -> Codec:
    """One codec per worker process."""
    if (path, pattern, most) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern, most] = Codec(path, pattern, most)
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)  # it makes many small tuples that stay
    return _codecs[path, pattern, most]


def _usual_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return path, pattern


def encode_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, digests: bool = False, most: int = 500_000) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids`` (array of int) and ``decoded`` text; with
    ``digests`` their SHA-256 as ``ids_sha256`` and ``decoded_sha256`` instead.

    ``path`` names a rank file that every worker has, ``pattern`` the split before the
    merges; no special tokens. Rows are independent: no shuffle, one document in memory at
    a time, and at most ``most`` words and pieces with their ids in each worker. A null or
    empty text has no tokens; null and repeated ids are kept as they
    are; other columns are ignored.
    """
    path, pattern = _settings(path, pattern)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kinds = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern, most)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raws = [coder.encode(t) for t in part.column(1).to_pylist()]
                counts = [len(raw) // 4 for raw in raws]
                if digests:
                    ids = [hashlib.sha256(raw).hexdigest() for raw in raws]
                    decoded = [back.hexdigest() for back in map(hashlib.sha256, coder.decode_all(raws))]
                else:
                    ids = [np.frombuffer(raw, "<i4") for raw in raws]
                    decoded = [back.decode() for back in coder.decode_all(raws)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, kinds[0][1]), pa.array(decoded, kinds[1][1])], ["id", "n_tokens", kinds[0][0], kinds[1][0]])

    types = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, {types}").withColumnRenamed("id", id)
