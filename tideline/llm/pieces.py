"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type model joins the best-scored adjacent pair first. Here every
candidate on the agenda is first put to a keyed hash of (seed, epoch, document,
place of the word in it, place in the word): with probability ``dropout`` it is
skipped for good, as though the pair could not be joined. Without dropout the
ids are the library's own. Segmentations vary between occurrences, documents,
epochs and seeds, are the same in every run, and all decode to the text.

The skips of all candidates of a slice of texts are drawn in numpy. A word none
of whose usual merges is skipped is cut as without dropout; the agendas of all
others run side by side, one merge a step, each word's symbol borders as the
bits of an integer. What a worker remembers of a word is its candidates and its
usual cut; candidates of new words are found by rolling hashes, and compared.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only_cache, prepare, table, text_slices
from .shingles import _mix
from .tokenizing import tokenizer_path

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED, VARIANTS = 0.1, 17, 2
#: Words that a worker remembers; the cache starts over when it is full.
CACHE_WORDS = 400_000
#: Characters of a word whose borders fit an integer; longer words are cut one by one.
MASK_BITS = 62
#: Words whose agendas run side by side.
LOCKSTEP = 1 << 15
SPACE = "▁"
_GAPS = re.compile(" +[^ ]*")
_loaded: dict[tuple, "Pieces"] = {}


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _spot(code: np.ndarray) -> np.ndarray:
    return ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of begin, begin + 1, ... up to each size, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Column:
    """An array that grows."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end, 2 * self.n) - len(self.data), self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Pieces:
    """A model's pieces, and the words already cut."""

    def __init__(self, path: str, dropout: float, seed: int, epoch: int, variants: int):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_id, self.unknown = {}, lib.unk_id()
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.rank[piece] = (-lib.get_score(i), i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        if len(self.byte_id) < 256:
            raise ValueError("decoding is lossless only with byte pieces")
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.key = f"{seed}:{epoch}:"
        self.limit = int(dropout * (1 << 32))
        self.longest = max(map(len, self.rank), default=1)
        self._index_pieces()
        self._forget()

    def _index_pieces(self) -> None:
        """Tables that tell the pieces among many substrings at once."""
        texts = [p for p in self.rank if len(p) > 1]
        scores = np.unique([self.rank[p][0] for p in texts], return_inverse=True)[1]
        hashes, letters = np.zeros(len(texts), np.uint64), np.zeros((len(texts), self.longest), np.uint32)
        for i, p in enumerate(texts):
            h = 0
            for k, c in enumerate(map(ord, p)):
                h = (h * int(_STEP) + c + 1) & 0xFFFFFFFFFFFFFFFF
                letters[i, k] = c
            hashes[i] = h
        order = np.argsort(hashes)
        self.hashes, self.letters = hashes[order], letters[order]
        self.scores, self.ids = scores[order], np.array([self.rank[p][1] for p in texts], np.uint16)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_spot(self.hashes)] = True

    def _forget(self) -> None:
        """Start over with what is remembered of words."""
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        #: Candidates of all words, those of one together and best first: hash of place, bits of both
        #: borders and of what lies between, first place, id, and whether the usual cut merges it.
        self.places, self.ends, self.inner, self.firsts, self.merged, self.taken = map(_Column, (np.uint32, np.int64, np.int64, np.uint8, np.uint16, bool))
        #: Of each word: where its candidates begin, how many they are, all its borders (0: it is cut
        #: by itself), and whether a line break opens it. Then its letters' ids and those of its usual cut.
        self.begins, self.counts, self.starts, self.opening = map(_Column, (np.int64, np.int64, np.int64, bool))
        self.letter_ids, self.letters_at, self.letters_n = map(_Column, (np.uint16, np.int64, np.int64))
        self.usual, self.usual_at, self.usual_n = map(_Column, (np.uint16, np.int64, np.int64))

    @staticmethod
    def _place(a, c):
        return (a * 0x9E3779B1 + c * 0x85EBCA77) & 0xFFFFFFFF

    def cut(self, word: str, base: int) -> list[int]:
        """Ids of one word, whose spaces are ``SPACE`` already; ``base`` is the hash of its place."""
        n, rank, limit = len(word), self.rank, self.limit
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if found := rank.get(word[i : i + 2]):
                agenda.append((found[0], i, i + 1, i + 2))
        heapq.heapify(agenda)
        end = after[:]  # end[i]: where the symbol that starts at i ends; 0 once it has been joined to the left
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if end[a] != b or b >= n or end[b] != c:
                continue  # one of the two has changed since
            if limit:
                x = base ^ self._place(a, c)
                x = ((x ^ x >> 16) * 0x7FEB352D) & 0xFFFFFFFF
                x = ((x ^ x >> 15) * 0x846CA68B) & 0xFFFFFFFF
                if (x ^ x >> 16) < limit:
                    continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if found := rank.get(word[a : end[c]]):
                    heapq.heappush(agenda, (found[0], a, c, end[c]))
            p = before[a]
            if p >= 0 and (found := rank.get(word[p:c])):
                heapq.heappush(agenda, (found[0], p, a, c))
        ids, i = [], 0
        while i < n:
            if found := rank.get(word[i : end[i]]):
                ids.append(found[1])
            else:
                ids += [self.byte_id[b] for b in word[i : end[i]].encode("utf-8", "replace")]
            i = end[i]
        return ids

    def _word(self, word: str, base: int) -> bytes:
        """A space and what follows it up to the next; or a line break and what follows it."""
        if SPACE in word:  # the sign itself, told apart from a space by its bytes
            ids: list[int] = []
            for k, part in enumerate(word.split(SPACE)):
                if k:
                    ids += [self.byte_id[b] for b in SPACE.encode()]
                ids += self.cut(part.replace(" ", SPACE), base ^ zlib.crc32(b"%d" % k))
        elif word[:1] == "\n":
            ids = [self.byte_id[10], *self.cut(word[1:], base)]
        else:
            ids = self.cut(word.replace(" ", SPACE), base)
        return np.array(ids, "<u2").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Number new words, find their candidates and cut them as without dropout."""
        first = len(self.words)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.words += words
        opening = np.array([w[0] == "\n" for w in words])
        own = [w[1:] if w[0] == "\n" else w for w in words]
        sizes = np.array(list(map(len, own)))
        letters = np.frombuffer("".join(own).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Long words, and ones with letters that are no pieces or with the sign for a space itself, are cut one by one.
        seen, which = np.unique(letters, return_inverse=True)
        ids = np.array([self.rank.get(chr(c), (0, -1))[1] if c < 0x110000 else -1 for c in seen.tolist()], np.int64)[which] if len(seen) else np.zeros(0, np.int64)
        alone = sizes > MASK_BITS
        alone[owner[ids < 0]] = True
        alone |= np.array([SPACE in w for w in words])
        rest = sizes[owner] - at
        pos = np.flatnonzero(~alone[owner])
        code = letters[pos].astype(np.uint64) + np.uint64(1)
        found = []
        for n in range(2, self.longest + 1):
            long = rest[pos] >= n
            pos, code = pos[long], code[long]
            if not len(pos):
                break
            code = code * _STEP + (letters[pos + (n - 1)].astype(np.uint64) + np.uint64(1))
            hit = np.flatnonzero(self.maybe[_spot(code)])
            row = np.minimum(np.searchsorted(self.hashes, code[hit]), len(self.hashes) - 1)
            same = self.hashes[row] == code[hit]
            hit, row = pos[hit[same]], row[same]
            same = (self.letters[row, :n] == letters[hit[:, None] + np.arange(n)]).all(1)
            found.append(np.stack([hit[same], np.full(int(same.sum()), n), row[same]]))
        where, n, row = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        word, a = owner[where], at[where]
        order = np.argsort(((word << 16 | self.scores[row]) << 6 | a) << 6 | n)
        word, a, c, row = word[order], a[order], (a + n)[order], row[order]
        counts = np.bincount(word, minlength=len(words))
        one = np.int64(1)
        self.begins.add(len(self.places) + np.cumsum(counts) - counts), self.counts.add(counts)
        self.starts.add(np.where(alone, 0, (np.int64(2) << np.minimum(sizes, MASK_BITS)) - 1)), self.opening.add(opening)
        self.places.add((a * 0x9E3779B1 + c * 0x85EBCA77) & 0xFFFFFFFF), self.firsts.add(a), self.merged.add(self.ids[row])
        self.ends.add(one << a | one << c), self.inner.add((one << c) - (one << (a + 1))), self.taken.add(np.zeros(len(a), bool))
        self.letters_at.add(len(self.letter_ids) + np.cumsum(sizes) - sizes), self.letters_n.add(sizes)
        self.letter_ids.add(np.maximum(ids, 0))
        numbers = first + np.flatnonzero(~alone)
        borders = self._run_agendas(numbers, np.zeros(int(self.counts.all()[numbers].sum()), bool), learn=True)
        flat, own_n = self._ids_between(numbers, borders)
        n = np.zeros(len(words), np.int64)
        n[numbers - first] = own_n
        self.usual_at.add(len(self.usual) + np.cumsum(n) - n), self.usual_n.add(n), self.usual.add(flat)

    def _spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the candidates of all ``numbers`` in order, where each one's begin)."""
        sizes = self.counts.all()[numbers]
        return _ranges(self.begins.all()[numbers], sizes), np.cumsum(sizes) - sizes

    def _run_agendas(self, numbers: np.ndarray, skipped: np.ndarray, learn: bool = False) -> np.ndarray:
        """Borders left in each word once its agenda is empty; ``skipped`` marks candidates in the order of :meth:`_spread`.

        A candidate is due when both its borders stand and just one between
        them; the best one due is merged, which takes that one away.
        """
        out = self.starts.all()[numbers]
        rows, begins = self._spread(numbers)
        sizes = self.counts.all()[numbers]
        for low, high in ((1, 8), (9, 24), (25, 1 << 30)):  # words of like many candidates share a table
            some = np.flatnonzero((sizes >= low) & (sizes <= high))
            for k in range(0, len(some), LOCKSTEP):
                own = some[k : k + LOCKSTEP]
                width = int(sizes[own].max())
                at = np.arange(width) < sizes[own][:, None]
                index = np.where(at, begins[own][:, None] + np.arange(width), 0)
                table = rows[index]
                at &= ~skipped[index]
                ends = np.where(at, self.ends.all()[table], np.int64(-1))
                inner = self.inner.all()[table]
                state, live = out[own], np.arange(len(own))
                while len(live):
                    now = state[live, None]
                    within = now & inner
                    due = ((now & ends) == ends) & (within != 0) & ((within & (within - 1)) == 0)
                    best = due.argmax(1)
                    left = due[np.arange(len(live)), best]
                    live, best, within, ends, inner, table = live[left], best[left], within[left], ends[left], inner[left], table[left]
                    each = np.arange(len(live))
                    state[live] &= ~within[each, best]
                    if learn:
                        self.taken.all()[table[each, best]] = True
                out[own] = state
        return out

    def _ids_between(self, numbers: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces between the borders of each word, in order; how many each has)."""
        rows, sizes = self._spread(numbers)[0], self.counts.all()[numbers]
        owner = np.repeat(np.arange(len(numbers)), sizes)
        state, ends = borders[owner], self.ends.all()[rows]
        whole = np.flatnonzero(((state & ends) == ends) & ((state & self.inner.all()[rows]) == 0))
        sizes = self.letters_n.all()[numbers]
        letters = _ranges(self.letters_at.all()[numbers], sizes)
        of = np.repeat(np.arange(len(numbers)), sizes)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        single = np.flatnonzero((borders[of] >> at & 3) == 3)
        breaks = np.flatnonzero(self.opening.all()[numbers])
        who = np.concatenate([owner[whole], of[single], breaks])
        place = np.concatenate([self.firsts.all()[rows[whole]] + np.int64(1), at[single] + 1, np.zeros(len(breaks), np.int64)])
        ids = np.concatenate([self.merged.all()[rows[whole]], self.letter_ids.all()[letters[single]], np.full(len(breaks), self.byte_id[10], np.uint16)])
        return ids[np.argsort(who << 7 | place)], np.bincount(who, minlength=len(numbers))

    def _bases(self, n: int, draw: int) -> np.ndarray:
        """A hash for each place of a word in the document ``draw``."""
        x = np.arange(n, dtype=np.uint64) + np.uint64(zlib.crc32(f"{self.key}{draw}".encode())) * np.uint64(1 << 32)
        return (_mix(_mix(x) ^ np.uint64(draw & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32)

    def _split(self, text: str) -> list[str]:
        """Words of a text with a space before it, as the model has it: a space and what follows, or a line break and what follows."""
        if "  " in text or " \n" in text or text[0] == " ":
            return _GAPS.findall(" " + text)
        return [w if w[:1] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]

    def encode(self, texts: list[str], draws: list[int]) -> list[bytes]:
        """16-bit little-endian ids of each text; a number of ``draws`` stands for the document."""
        if self.crossing:
            return [self._word(" " + t, int(self._bases(1, d)[0])) if t else b"" for t, d in zip(texts, draws, strict=True)]
        words = [self._split(t) if t else [] for t in texts]
        if new := set().union(*words).difference(self.known):
            if len(self.words) + len(new) > CACHE_WORDS:
                self._forget()
                new = set().union(*words)
            self._learn(list(new))
        get = self.known.__getitem__
        numbers = np.array([get(w) for own in words for w in own], np.int64)
        if not len(numbers):
            return [b""] * len(texts)
        bases = np.concatenate([self._bases(len(own), d) for own, d in zip(words, draws, strict=True)])
        parts = [self._cut_all(numbers[k : k + LOCKSTEP], bases[k : k + LOCKSTEP]) for k in range(0, len(numbers), LOCKSTEP)]
        raw = np.concatenate([p[0] for p in parts]).astype("<u2").tobytes()
        ends = np.r_[0, np.cumsum(np.concatenate([p[1] for p in parts]))][np.cumsum([len(own) for own in words])] * 2
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _cut_all(self, numbers: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words at their places, in order; how many each has)."""
        sizes = self.usual_n.all()[numbers].copy()
        other: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their ids, how many each has
        alone = np.flatnonzero(self.starts.all()[numbers] == 0)
        if len(alone):
            own = [np.frombuffer(self._word(self.words[n], b), "<u2") for n, b in zip(numbers[alone].tolist(), bases[alone].tolist(), strict=True)]
            other.append((alone, np.concatenate(own), np.array(list(map(len, own)))))
        if self.limit:
            other.append(self._varied(numbers, bases))
        for at, _, n in other:
            sizes[at] = n
        out, begins = np.zeros(int(sizes.sum()), np.uint16), np.cumsum(sizes) - sizes
        usual = np.ones(len(numbers), bool)
        for at, ids, n in other:
            usual[at] = False
            out[_ranges(begins[at], n)] = ids
        rest = np.flatnonzero(usual)
        out[_ranges(begins[rest], sizes[rest])] = self.usual.all()[_ranges(self.usual_at.all()[numbers[rest]], sizes[rest])]
        return out, sizes

    def _varied(self, numbers: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words skip a usual merge, their ids, how many each has)."""
        rows, begins = self._spread(numbers)
        sizes = self.counts.all()[numbers]
        x = self.places.all()[rows] ^ np.repeat(bases, sizes)
        x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)
        x = (x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B)
        skipped = (x ^ x >> np.uint32(16)) < self.limit
        hit = np.zeros(len(numbers), bool)
        hit[np.repeat(np.arange(len(numbers)), sizes)[skipped & self.taken.all()[rows]]] = True
        odd = np.flatnonzero(hit)
        borders = self._run_agendas(numbers[odd], skipped[_ranges(begins[odd], sizes[odd])])
        return odd, *self._ids_between(numbers[odd], borders)

    def decode(self, raw: bytes) -> str:
        found = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(raw, "<u2").tolist()))
        return found[1:].decode("utf-8", "replace")


def pieces(path: str, dropout: float, seed: int, epoch: int, variants: int) -> Pieces:
    """The worker's own tables, kept across tasks until another operator's run there."""
    key = (path, dropout, seed, epoch, variants)
    only_cache("pieces", _loaded.clear)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(*key)
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED, epoch: int = 0, variants: int = VARIANTS, with_ids: bool = False) -> DataFrame:
    """Encode every text, decode it again and describe both.

    Columns: doc_id, variant, n_pieces, ids_crc32 (of the ids as unsigned 32-bit
    little-endian integers), text_sha256 (of the decoded text), lossless, and
    ids if asked for.

    Cuts are drawn for each doc_id and place of a word; ``variant`` is one of
    ``variants`` groups that documents fall into by the same hash.

    Null or empty text: no pieces, lossless. Null doc_id: drawn by the hash of
    null. Repeated rows: a row each, all alike. Of equal candidates the first
    in the word is joined first. Empty table: no rows. Other columns are
    ignored. Texts of any length are encoded whole.
    """
    prepare(docs.sparkSession)
    where = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(where, dropout, seed, epoch, variants)
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                docs_, texts, variants_, draws = (part.column(c).to_pylist() for c in ("doc_id", "text", "variant", "draw"))
                for doc, text, variant, raw in zip(docs_, texts, variants_, own.encode([t or "" for t in texts], draws), strict=True):
                    back = own.decode(raw) if raw else ""
                    ids = np.frombuffer(raw, "<u2")
                    rows.append((doc, variant, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (text or ""), ids.astype(np.int32)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
                width = 6 + with_ids
                arrays = [pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True))[:width], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "variant", "n_pieces", "ids_crc32", "text_sha256", "lossless", "ids"][:width])

    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.pmod(draw, F.lit(variants)).cast("int").alias("variant"), draw.alias("draw"))
    return rows.mapInArrow(run, "doc_id long, variant int, n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean" + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    prepare(encoded.sparkSession)
    where = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(where, 0.0, 0, 0, 1)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, "<u2").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
