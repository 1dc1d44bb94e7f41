"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Pieces and scores come from a SentencePiece BPE model. A text is cut where no piece can
reach across (before each run of spaces, and, in texts with other spacing, between
characters that no piece holds side by side). The agenda of each segment takes the best
merge (best score, leftmost among equals) and skips it with the dropout rate: each
occurrence of a segment has its own key, from a hash of seed, document and place, and
each candidate merge its own draw, a hash of that key and the candidate's number. Without
dropout the ids are those of the library. Characters that are no piece become byte
pieces, a literal U+2581 too, so that decoding gives back every text.

An Arrow batch of texts is encoded together: the distinct segments once without a skip,
then the occurrences of which some draw skips a merge, as rows of a matrix
(``pair_merges``). Nothing is remembered between batches. Segments of more than
``LONG`` characters have an agenda of their own, with the same draws.

Defined cases: a null text is an empty text and has no ids; a null doc_id is kept (a key
of its own); equal rows get equal ids; an empty table gives no row; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pair_merges import Pairs, first_ranks, matrix, merge, mixed, skipped
from .shared import short_batches, table, tidy

SPACE = "▁"
LONG = 48  # characters of a segment that still is a row of a matrix
ROWS = 1 << 15  # rows that are merged together
SLICE = 1 << 18  # segments whose ids are put together at once
OTHER = 1 << 21  # symbols of characters that are in no piece begin here
U = np.uint64


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begins[i] .. begins[i] + sizes[i] - 1 of all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceBpe:
    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {pieces[i]: i for i in normal}
        self.cost = {pieces[i]: -model.get_score(i) for i in normal}
        self.byte = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if model.is_byte(i)}
        self.joins = {p[k : k + 2] for p in self.cost for k in range(len(p) - 1)}
        if any(j[1] == SPACE and j[0] != SPACE for j in self.joins):
            raise ValueError("pieces of this model reach across spaces")
        self.seed, self.dropout = seed, dropout
        # Symbols: ids of pieces, then characters that are only parts of pieces, then (from
        # OTHER) all other characters.
        chars = sorted({c for p in self.cost for c in p if c not in self.ids})
        self.symbol = self.ids | {c: len(pieces) + i for i, c in enumerate(chars)}
        self.n_pieces = len(pieces)
        self.char_of = {s: c for c, s in self.symbol.items() if s >= self.n_pieces}
        self.of_code_point = OTHER + np.arange(0x110000, dtype=np.int32)
        for c, s in self.symbol.items():
            if len(c) == 1:
                self.of_code_point[ord(c)] = s
        joined = sorted((p for p in self.cost if len(p) > 1), key=lambda p: (self.cost[p], p))
        rows = [(self.symbol[p[:k]], self.symbol[p[k:]], r) for r, p in enumerate(joined) for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        left, right, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.pairs = Pairs(left, right, rank, np.array([self.ids[p] for p in joined]), np.array([self.cost[p] for p in joined]))
        raw = [b""] * len(pieces)
        for i in normal:
            raw[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = np.array(raw, object)

    def agenda(self, segment: str, key: int) -> list[str]:
        """One segment's agenda as a heap: best score first, leftmost among equals. The n-th
        candidate is skipped if the n-th draw of ``key`` says so."""
        cost, parts, n = self.cost, list(segment), len(segment)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(cost[m], i, 2) for i in range(n - 1) if (m := segment[i : i + 2]) in cost]
        heapq.heapify(agenda)
        draws, at = [], 0
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = right[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != size:
                continue
            if self.dropout:
                if at == len(draws):
                    draws += skipped(np.full(256, key, U), np.arange(at, at + 256), self.dropout).tolist()
                at += 1
                if draws[at - 1]:
                    continue
            parts[i] += parts[j]
            parts[j] = ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                m = parts[i] + parts[k]
                if m in cost:
                    heapq.heappush(agenda, (cost[m], i, len(m)))
            h = left[i]
            if h >= 0:
                m = parts[h] + parts[i]
                if m in cost:
                    heapq.heappush(agenda, (cost[m], h, len(m)))
        return [p for p in parts if p]

    def _cuts(self, text: str) -> list[str]:
        """Segments of ``text`` with spaces as U+2581, cut before each run of them and at
        line ends."""
        out = []
        spaced = text.replace(" ", SPACE)
        begin = 0
        for i in range(1, len(spaced)):
            if spaced[i - 1 : i + 1] not in self.joins:
                out.append(spaced[begin:i])
                begin = i
        out.append(spaced[begin:])
        return out

    def _segments(self, text: str) -> list[str | None]:
        """Segments of a text; None is a literal U+2581."""
        segments = []
        for n, part in enumerate(text.split(SPACE) if text else ()):
            part = " " + part if n == 0 else part
            if n:
                segments.append(None)
            if not part:
                continue
            if "  " in part or part[-1] == " " or n:
                segments += self._cuts(part)
            else:
                segments += [SPACE + w for w in part[1:].split(" ")]
        return segments

    def _split(self, texts: pa.Array) -> pa.Array:
        whole = texts.to_pylist()
        if all(t and t[0] != " " and t[-1] != " " and "  " not in t and SPACE not in t for t in whole):
            return pc.split_pattern(pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", " " + SPACE), ""), " ")
        return pa.array([self._segments(t) for t in whole], pa.list_(pa.string()))

    def _plain(self, known: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the distinct segments' characters, where each begins, and its size."""
        points = np.frombuffer("".join(known).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        return self.of_code_point[points], np.cumsum(sizes) - sizes, sizes

    def _merged(self, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of the segments ``which`` (short ones), one after the other, and
        the number of each."""
        counts, parts = np.zeros(len(which), np.int64), []
        order = np.argsort(sizes[which], kind="stable")  # rows of like width together
        for low in range(0, len(which), ROWS):
            mine = order[low : low + ROWS]
            seg = which[mine]
            # Each distinct segment's first ranks are looked up once.
            one, of = np.unique(seg, return_inverse=True)
            symbols = matrix(chars[_ragged(begins[one], sizes[one])], sizes[one])
            ranks = first_ranks(self.pairs, symbols)
            if len(one) < len(seg) or keys is not None:
                symbols, ranks = symbols[of], ranks[of]
                merge(self.pairs, symbols, ranks, None if keys is None else keys[mine], 0.0 if keys is None else self.dropout)
            else:
                merge(self.pairs, symbols, ranks)
                symbols = symbols[of]
            kept = symbols >= 0
            counts[mine] = kept.sum(1)
            parts.append(symbols[kept])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # Back from the order of sizes to that of ``which``.
        sorted_counts = counts[order]
        begin = np.empty(len(which), np.int64)
        begin[order] = np.cumsum(sorted_counts) - sorted_counts
        return flat[_ragged(begin, counts)], counts

    def _long(self, segment: str, key: int) -> np.ndarray:
        parts = self.agenda(segment, key)
        return np.array([self.symbol.get(p, OTHER + ord(p)) if len(p) == 1 else self.ids[p] for p in parts], np.int32)

    def _to_ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with bytes for characters that are no piece; and the number for each row."""
        odd = np.flatnonzero(symbols >= self.n_pieces)
        if not len(odd):
            return symbols, sizes
        found = [[self.byte[b] for b in (self.char_of.get(s) or chr(s - OTHER)).encode()] for s in symbols[odd].tolist()]
        n = np.ones(len(symbols), np.int64)
        n[odd] = [len(f) for f in found]
        ends = np.cumsum(n)
        out = np.repeat(symbols, n)
        out[_ragged(ends[odd] - n[odd], n[odd])] = np.concatenate([np.array(f, np.int32) for f in found])
        row_ends = np.concatenate(([0], ends))[np.cumsum(sizes)]
        return out, np.diff(row_ends, prepend=0)

    def encode_batch(self, texts: pa.Array, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (null: empty) and where those of each begin (one place more than
        there are texts); ``keys`` (documents' ids) key the draws."""
        texts = pc.fill_null(texts, "")
        lists = self._split(texts)
        each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(each)))
        coded = lists.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        codes = coded.indices.fill_null(len(known)).to_numpy().astype(np.int64)  # the last: a literal U+2581
        chars, begins, sizes = self._plain(known)
        short = np.flatnonzero(sizes <= LONG)
        flat, n = self._merged(chars, begins, sizes, short, None)
        drop = self.dropout
        counts = np.zeros(len(known) + 1, np.int64)
        counts[short] = n
        pool, pool_n = [flat], [n]
        place = np.full(len(codes), -1, np.int64)  # of each occurrence in the pool
        at_of = np.full(len(known) + 1, -1, np.int64)
        at_of[short] = np.arange(len(short))
        filled = len(short)
        literal = np.array([self.byte[b] for b in SPACE.encode()], np.int32)
        pool.append(literal)
        pool_n.append([len(literal)])
        at_of[len(known)] = filled
        filled += 1
        is_long = np.concatenate((sizes > LONG, [False]))
        if drop and len(codes):
            bases = np.array([int.from_bytes(hashlib.blake2b(f"{self.seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys], U)
            own = mixed(np.repeat(bases, each) + (np.arange(len(codes)) - np.repeat(bounds[:-1], each)).astype(U) * U(0xD1342543DE82EF95))
            # Candidates that the agenda takes if none is skipped: one for each merge.
            merges = np.concatenate((sizes, [0])) - counts
            merges[is_long] = 0
            merges[-1] = 0
            some, open_, m, j = np.zeros(len(codes), bool), np.arange(len(codes)), merges[codes], 0
            while True:
                open_ = open_[m[open_] > j]
                if not len(open_):
                    break
                hit = skipped(own[open_], j, drop)
                some[open_[hit]] = True
                open_, j = open_[~hit], j + 1
            some = np.flatnonzero(some)
            flat, n = self._merged(chars, begins, sizes, codes[some], own[some])
            pool.append(flat)
            pool_n.append(n)
            place[some] = filled + np.arange(len(some))
            filled += len(some)
        for i in np.flatnonzero(is_long[codes]).tolist() if is_long.any() else ():
            flat = self._long(known[codes[i]], int(own[i]) if drop else 0)
            pool.append(flat)
            pool_n.append([len(flat)])
            place[i] = filled
            filled += 1
        rest = place < 0
        place[rest] = at_of[codes[rest]]
        held, held_n = self._to_ids(np.concatenate(pool), np.concatenate(pool_n).astype(np.int64))
        start, size = (np.cumsum(held_n) - held_n)[place], held_n[place]
        before = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(before[-1]), np.int32)
        for low in range(0, len(codes), SLICE):
            part = slice(low, low + SLICE)
            out[before[low] : before[min(low + SLICE, len(codes))]] = held[_ragged(start[part], size[part])]
        return out, before[bounds]

    def encode(self, text: str | None, key: object = None) -> np.ndarray:
        """Ids of a whole text; ``key`` (a document's id) keys the draws."""
        return self.encode_batch(pa.array([text], pa.string()), [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(self.raw[ids].tolist())
        return data[1:].decode() if len(ids) else ""


_LOADED: dict[tuple, PieceBpe] = {}


def load(*options) -> PieceBpe:
    if options not in _LOADED:
        _LOADED.clear()
        _LOADED[options] = PieceBpe(*options)
    return _LOADED[options]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id and ids of each document of ``docs(doc_id, text)``."""
    short_batches(docs.sparkSession)
    options = (path or default_path(), dropout, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(*options)
        for batch in batches:
            ids, starts = bpe.encode_batch(batch.column(1), batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and the text of each row of ``encoded(doc_id, ids)``."""
    short_batches(encoded.sparkSession)
    options = (path or default_path(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(*options, 0.0, 0) if options not in [k[:1] for k in _LOADED] else next(v for k, v in _LOADED.items() if k[:1] == options)
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
            parts = np.split(flat, np.cumsum(np.nan_to_num(ends).astype(int))[:-1]) if batch.num_rows else []
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                    pa.array([bpe.decode(p) for p in parts], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "text"],
            )

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_crc32 long, text string")


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents with dropout and decodes them again; ``decoded_sha256`` is
    that of the text (null: empty) in UTF-8."""
    rows = decode(encode(table(spark, sf_dir, "documents"), dropout=0.1, seed=1))
    return rows.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
