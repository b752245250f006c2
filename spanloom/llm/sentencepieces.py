"""SentencePiece encoding and decoding by suffix-array matching.

A batch's words that the worker does not know are written one after the other and indexed by a suffix array. All pieces
are looked up together: character by character, a binary search narrows the range of suffixes that begin with a piece's
first characters, and only pieces whose beginning occurs go on. The range of a whole piece gives its occurrences.
Occurrences are edges from their first to their last position; sorted by where they end, they are relaxed from left to
right, in all words of the batch at once. In a model of merges, the encoding of a prefix is the one of a shorter prefix
followed by one piece, and two pieces can follow each other exactly if encoding their joined text gives the two again;
so an edge relaxes its end if its piece may follow the piece that ended where it begins, and one edge at most does.
Characters without a piece fall back to their bytes.

Words are cut before each run of word marks (the model's pieces hold marks at their head only). Normalisation is the
library's own. Null counts as empty (no pieces); repeated rows stay; texts are encoded whole, whatever their length, and
so is a text that is one unbroken word (work and memory are linear in it); an empty table gives an empty result; further
columns are not read. There are no ties: a text has one encoding.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, text_frame

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words of each of the two generations that a worker remembers, the longest that it does, characters that are indexed
#: together, and the length up to which words are relaxed side by side.
CACHE_WORDS, CACHE_CHARS, BATCH_CHARS, SIDE_BY_SIDE = 250_000, 48, 400_000, 64
_CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: What ended at a position: nothing yet, the word's start, a character as bytes; else the number of a piece.
NONE, START, BYTES = -3, -2, -1
#: Slots of the table that answers most questions of whether a piece may follow another.
SLOTS = 1 << 21


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def suffix_array(codes: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes by their first ``reach`` characters: as many as fit into a word are compared at once, then
    the compared length doubles."""
    n = len(codes)
    seen = np.zeros(int(codes.max()) + 1 if n else 1, dtype=bool)
    seen[codes] = True
    rank = np.cumsum(seen)[codes]  # from 1; 0 is beyond the end
    bits = int(seen.sum()).bit_length()
    k = max(1, min(reach, 62 // bits))
    padded = np.concatenate([rank, np.zeros(k, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(k):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    while k < reach and k < n:
        rank = np.empty(n, dtype=np.int64)
        step = key[order]
        rank[order] = np.concatenate(([1], 1 + np.cumsum(step[1:] != step[:-1])))
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second
        order = np.argsort(key)
        k *= 2
    return order


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.name = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.id = {self.name[i]: i for i in plain}
        self.score = {i: self.library.get_score(i) for i in plain}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        number = {i: b for b, i in enumerate(self.byte)}
        self.bytes_of = [bytes([number[i]]) if i in number else self.name[i].replace(MARK, " ").encode("utf-8", "surrogatepass") for i in range(n)]
        #: Encodings as little-endian 32-bit ids, of words met lately and of those met before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.slot_key, self.slot_value = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=bool)
        self.levels = self._trie(plain)
        single = np.array(sorted(ord(self.name[i]) for i in plain if len(self.name[i]) == 1), dtype=np.int64)
        self.has_piece = np.zeros(0x110000, dtype=bool)
        self.has_piece[single] = True

    def _trie(self, plain: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Beginnings of pieces by length: (sorted keys of parent and next character, piece or -1, parent)."""
        out, parents, depth = [], {"": 0}, 0
        names = sorted(self.id)
        while parents:
            depth += 1
            now = sorted({x[:depth] for x in names if len(x) >= depth})
            if not now:
                break
            parent = np.array([parents[x[:-1]] for x in now], dtype=np.int64)
            code = np.array([ord(x[-1]) for x in now], dtype=np.int64)
            out.append(((parent << 21) | code, np.array([self.id.get(x, -1) for x in now], dtype=np.int64), parent))
            parents = {x: i for i, x in enumerate(now)}
        return out

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, the leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        said = self.follows.get(key)
        if said is None:
            if len(self.follows) > 600_000:
                self.follows.clear()
            said = self.follows[key] = self.merged(self.name[a] + self.name[b]) == [self.name[a], self.name[b]]
        return said

    def all_may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow of many pairs."""
        key = (a << 20) | b
        slot = (key * 0x9E3779B1 >> 9) & (SLOTS - 1)
        missing = np.flatnonzero(self.slot_key[slot] != key)
        out = self.slot_value[slot]
        if len(missing):
            new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            said = np.array([self.may_follow(k >> 20, k & 0xFFFFF) for k in new.tolist()], dtype=bool)
            self.slot_key[slot[missing][first]] = new
            self.slot_value[slot[missing][first]] = said
            # two pairs of one slot: the key that stayed may not be the one whose value was written last
            both = slot[missing][first]
            self.slot_value[both] = np.where(self.slot_key[both] == new, said, self.slot_value[both])
            out[missing] = said[back]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece."""
        n, reach = len(codes), len(self.levels)
        order = suffix_array(codes, reach)
        padded = np.concatenate([codes, np.zeros(reach + 1, dtype=np.int64)])
        group = np.zeros(n, dtype=np.int64)
        starts, ends, ids = [], [], []
        for depth, (keys, pieces, parent) in enumerate(self.levels):
            # suffixes by parent and next character are in order, so each beginning is a range
            own = (group << 21) | padded[order + depth]
            alive = np.zeros(int(parent[-1]) + 2, dtype=bool)
            alive[group[group < len(alive)]] = True
            asked = np.flatnonzero(alive[parent])
            lo, hi = np.searchsorted(own, keys[asked], "left"), np.searchsorted(own, keys[asked], "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                break
            count = (hi - lo)[hit]
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)
            order, group = order[place], np.repeat(asked[hit], count)
            piece = pieces[group]
            whole = np.flatnonzero(piece >= 0)
            starts.append(order[whole])
            ends.append(order[whole] + depth + 1)
            ids.append(piece[whole])
        if not starts:
            return (np.zeros(0, dtype=np.int64),) * 3
        s, e, i = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        keep = e <= n
        return s[keep], e[keep], i[keep]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of words that are new to the worker, indexed together."""
        out: dict[str, bytes] = {}
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            group, size = [], 0
            side = len(words[at]) <= SIDE_BY_SIDE
            while at < len(words) and (not group or size + len(words[at]) < BATCH_CHARS) and (len(words[at]) <= SIDE_BY_SIDE) == side:
                group.append(words[at])
                size += len(words[at]) + 1
                at += 1
            # words are parted by a character that no piece holds
            codes = codes_of("\0".join(group))
            if side:
                self._relax_all(group, codes, out)
            else:
                self._relax_each(group, codes, out)
        return out

    def _spelt(self, ended: int, char: str) -> list[int]:
        """Ids of what ended, last first."""
        return [ended] if ended >= 0 else [self.byte[b] for b in reversed(char.encode("utf-8", "surrogatepass"))]

    def _relax_all(self, words: list[str], codes: np.ndarray, out: dict) -> None:
        """Short words side by side: the edges that end at the first place of any word, at the second, and so on."""
        s, e, ids = self.edges(codes)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size + 1) - size - 1
        word = np.repeat(np.arange(len(words)), size + 1)
        step = e - begin[word[s]]
        by_step = np.argsort(step, kind="stable")
        s, e, ids, step = s[by_step], e[by_step], ids[by_step], step[by_step]
        most = int(size.max())
        bounds = np.searchsorted(step, np.arange(1, most + 2))
        ended, came = np.full(len(codes) + 1, NONE, dtype=np.int64), np.zeros(len(codes) + 1, dtype=np.int64)
        ended[begin] = START
        plain = self.has_piece[codes]
        lone = np.flatnonzero(~plain)
        lone = lone[lone - begin[word[lone]] < size[word[lone]]]  # not what parts the words
        at = lone - begin[word[lone]]
        lone = lone[np.argsort(at, kind="stable")]
        lone_bounds = np.searchsorted(np.sort(at), np.arange(most + 1))
        for k in range(most):
            part = slice(bounds[k], bounds[k + 1])
            before = ended[s[part]]
            there = np.flatnonzero(before != NONE)
            if len(there):
                before, piece = before[there], ids[part][there]
                ok = before < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.all_may_follow(before[ask], piece[ask])
                good = there[ok]
                ended[e[part][good]] = ids[part][good]
                came[e[part][good]] = s[part][good]
            alone = lone[lone_bounds[k] : lone_bounds[k + 1]] + 1
            alone = alone[ended[alone] == NONE]
            ended[alone] = BYTES
            came[alone] = alone - 1
        # back from the ends, in all words at once
        live, at, found = np.arange(len(words)), begin + size, []
        some_bytes = np.zeros(len(words), dtype=bool)
        count = np.zeros(len(words), dtype=np.int64)
        while len(live):
            got = ended[at]
            some_bytes[live[got == BYTES]] = True
            found.append((live, count[live], got))
            count[live] += 1
            at = came[at]
            more = at > begin[live]
            live, at = live[more], at[more]
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), dtype="<u4")
        for w, k, got in found:
            flat[first[w] + count[w] - 1 - k] = np.maximum(got, 0)
        raw, first, count = flat.tobytes(), first.tolist(), count.tolist()
        for k, w in enumerate(words):
            out[w] = raw[4 * first[k] : 4 * (first[k] + count[k])]
        for k in np.flatnonzero(some_bytes).tolist():
            out[words[k]] = self._back(words[k], ended, came, int(begin[k]))

    def _back(self, w: str, ended, came, begin: int) -> bytes:
        got: list[int] = []
        at = begin + len(w)
        while at > begin:
            got += self._spelt(int(ended[at]), w[at - begin - 1])
            at = int(came[at])
        return np.array(got[::-1], dtype="<u4").tobytes()

    def _relax_each(self, words: list[str], codes: np.ndarray, out: dict) -> None:
        """Long words one after the other, place by place."""
        s, e, ids = self.edges(codes)
        by_end = np.argsort(e, kind="stable")
        bounds = np.searchsorted(e[by_end], np.arange(len(codes) + 2))
        plain, may, at = self.has_piece[codes], self.may_follow, 0
        for w in words:
            n = len(w)
            here = by_end[bounds[at + 1] : bounds[at + n + 1]]
            starts, numbers, upto = (s[here] - at).tolist(), ids[here].tolist(), (bounds[at + 1 : at + n + 2] - bounds[at + 1]).tolist()
            ended, came, lone = [NONE] * (n + 1), [0] * (n + 1), plain[at : at + n].tolist()
            ended[0] = START
            for end in range(1, n + 1):
                for k in range(upto[end - 1], upto[end]):
                    before = ended[starts[k]]
                    if before != NONE and (before < 0 or may(before, numbers[k])):
                        ended[end], came[end] = numbers[k], starts[k]
                        break
                else:
                    if not lone[end - 1]:
                        ended[end], came[end] = BYTES, end - 1
            out[w] = self._back(w, ended, came, 0)
            at += n + 1

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of all texts, as little-endian 32-bit numbers."""
        cut = [_CUT.findall(self.library.normalize(t)) for t in texts]
        known, older = self.known, self.older
        new: dict[str, None] = {}
        for words in cut:
            for w in words:
                if w not in known:
                    got = older.get(w)
                    if got is None:
                        new[w] = None
                    else:
                        known[w] = got
        known.update(self.learn(list(new)))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        if len(known) > CACHE_WORDS:
            self.older, self.known = known, {}
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, dtype="<u4").tolist() for x in self.encode_bytes(texts)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes read as UTF-8, marks as spaces, the first one dropped."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_own: dict[str, Pieces] = {}


def pieces_for(path: str) -> Pieces:
    if path not in _own:
        _own.clear()
        _own[path] = Pieces(path)
    return _own[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = path or model_path()
    work = lambda batch: {"doc_id": batch.column("doc_id"), "ids": pieces_for(path).encode_all(batch.column("text").to_pylist())}
    return map_batches(text_frame(docs), work, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pieces_for(path).decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: encodings of all documents as digests, with the digest of what they decode to."""
    path = model_path()

    def work(batch):
        p = pieces_for(path)
        ids = p.encode_bytes(batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "n_pieces": [len(x) // 4 for x in ids],
            "ids_crc32": [zlib.crc32(x) for x in ids],
            "decoded_sha256": [hashlib.sha256(p.decode(np.frombuffer(x, dtype="<u4").tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in ids],
        }

    return map_batches(text_frame(table(spark, sf_dir, "documents")), work, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")


