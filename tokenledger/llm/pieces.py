"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across (before a space that follows other
text), and each distinct word of a batch is merged once.  All words lie in one flat array of symbol
ids.  In a round every word finds its best-ranked adjacent pair; all leftmost non-overlapping pairs
of that rank merge at once, and the array is compacted.  Where a merge would make a pair at least as
good as the present one, only the leftmost pair of that word merges in that round, so the result is
that of merging one pair after the other.  Symbols without a piece become their UTF-8 bytes.

A null text is the empty text, whose only id is the end id; texts may be of any length; ties between
equal scores go to the leftmost pair.  Rows, repeated or not, are independent of one another, an empty table gives no rows, and
extra columns are ignored, or kept by ``encode_decode``, which replaces those named ids and decoded.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tokenledger.llm.common import table

SPACE = "▁"
#: Characters merged at once; a batch of texts is cut into blocks of about this many.
BLOCK_CHARS = 1_000_000


class Vocabulary:
    """Pieces, scores and the table of pairs that form a piece, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if sp.normalize(f" a  b\téﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\téﬁ{SPACE}":
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        names = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)])
        self.eos, self.n_pieces = sp.eos_id(), n
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = {names[i]: i for i in range(n) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece reaches across words")
        # Symbols: pieces by id; characters that are no piece get ids after them.
        self.symbols = dict(plain)
        for p in plain:
            for c in p:
                self.symbols.setdefault(c, len(names) + len(self.symbols))
        self.size = max(self.symbols.values()) + 1
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranks = np.searchsorted(np.unique(-scores), -scores)  # equal scores, equal ranks
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self._place(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64), ranks)
        chars = [c for c in self.symbols if len(c) == 1]
        self.char_ids = np.full(0x110000, -1, np.int64)
        self.char_ids[[ord(c) for c in chars]] = [self.symbols[c] for c in chars]
        text = [b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            text[i] = bytes([b])
        self.piece_len = np.array([len(t) for t in text])
        self.piece_at = np.r_[0, np.cumsum(self.piece_len)[:-1]]
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)

    NONE = np.iinfo(np.int64).max

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _place(self, keys: np.ndarray, ids: np.ndarray, ranks: np.ndarray) -> None:
        """A table of pairs by a hash of their keys; a pair whose slot is taken stands in the next free one."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_keys, self.pair_ids, self.pair_ranks = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64), np.full(1 << bits, self.NONE)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.pair_keys[slot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            now = free & first
            self.pair_keys[slot[now]], self.pair_ids[slot[now]], self.pair_ranks[slot[now]] = keys[left[now]], ids[left[now]], ranks[ids[left[now]]]
            left, slot = left[~now], (slot[~now] + 1) & mask

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece each pair forms; NONE where there is none.  Unknown symbols are negative."""
        key = left * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        found = self.pair_keys[at]
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.pair_keys) - 1)
            found = self.pair_keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found != -1)]
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], self.NONE), self.pair_ids[at]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sym: symbol ids of all words one after the other; word: the rising word number of each."""
        done_sym, done_word = [], []
        while len(sym):
            rank, piece = np.full(len(sym), self.NONE), np.zeros(len(sym), np.int64)
            rank[:-1], piece[:-1] = self._ranks(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = self.NONE
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[start, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, start), count)
            live = best != self.NONE
            if not live.all():  # words without a pair are finished
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, piece, best = (x[live] for x in (sym, word, rank, piece, best))
                if not len(sym):
                    break
            hit = rank == best
            # In a run of overlapping hits every second one counts, from the left.
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            hit[at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            # What each merge would stand next to, if all of them happened.
            new = sym.copy()
            new[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            n, w = new[keep], word[keep]
            r = np.full(len(n), self.NONE)
            r[:-1] = self._ranks(n[:-1], n[1:])[0]
            r[:-1][w[:-1] != w[1:]] = self.NONE
            merged = hit[keep]
            beside = r.copy()
            beside[~merged] = self.NONE  # pairs to the right of a merge
            before = np.r_[merged[1:], False]  # and to the left
            beside[before] = np.minimum(beside[before], r[before])
            # Merging one at a time, a piece also meets the old right neighbour that a later merge consumes.
            follow = at[np.r_[np.diff(at) == 2, False]]
            close = np.full(len(sym), self.NONE)
            if len(follow):
                close[follow] = self._ranks(piece[follow], sym[follow + 2])[0]
                close[follow[word[follow] != word[follow + 2]]] = self.NONE
            unsafe_words = np.union1d(w[beside <= best[keep]], word[close <= best])
            if len(unsafe_words):
                risky = np.isin(word[at], unsafe_words)
                later = np.r_[False, word[at][1:] == word[at][:-1]]
                drop = at[risky & later]
                new[drop] = sym[drop]
                keep[drop + 1] = True
            sym, word = new[keep], word[keep]
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin (one more at the end)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.char_ids[points]
        sym = np.where(ids >= 0, ids, -1 - points)  # a character outside the vocabulary stays itself
        sym, word = self.merge(sym, np.repeat(np.arange(len(words)), lengths))
        bare = np.flatnonzero((sym < 0) | (sym >= self.n_pieces))
        if len(bare):
            back = {v: c for c, v in self.symbols.items() if v >= self.n_pieces}
            raw = [(chr(-1 - s) if s < 0 else back[s]).encode("utf-8", "surrogatepass") for s in sym[bare].tolist()]
            times = np.ones(len(sym), np.int64)
            times[bare] = [len(r) for r in raw]
            slot = np.repeat(np.isin(np.arange(len(sym)), bare), times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[slot] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        split = [cut(t) for t in texts]
        end = np.array([self.eos])
        words = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
        if not len(words):
            return [end for _ in texts]
        ids, starts = self.encode_words(words.dictionary.to_pylist())
        which = np.split(words.indices.to_numpy(), np.cumsum([len(ws) for ws in split])[:-1])
        return [np.append(gather(ids, starts[ws], starts[ws + 1] - starts[ws]), end) if len(ws) else end for ws in which]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: pieces and bytes in line, without the blank that encoding put in front."""
        ids = ids[self.piece_len[ids] > 0]
        raw = gather(self.piece_bytes, self.piece_at[ids], self.piece_len[ids]).tobytes()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


#: A word is a run of blanks with the text after it; nothing in a vocabulary crosses its end.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def cut(text: str | None) -> list[str]:
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def model_file(spark: SparkSession, path: str | None = None) -> str:
    """Ships the model to the executors' work folders; its base name."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """One per Python worker."""
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(SparkFiles.get(name))
    return _LOADED[name]


def blocks(batches: Iterator[pa.RecordBatch], column: str, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none but a single long text has many more characters than asked for."""
    for b in batches:
        size = np.cumsum([0 if x is None else x for x in pc.utf8_length(b[column]).to_pylist()])
        start = 0
        while start < len(size):
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + chars, "right")))
            yield b.slice(start, stop - start)
            start = stop


def encode_decode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ids (array of int) and decoded (string); columns of these names are replaced."""
    name = model_file(docs.sparkSession, model)
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for b in blocks(batches, text):
            ids = vocab.encode(b[text].to_pylist())
            offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
            decoded = pa.array([vocab.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, lists, decoded], names=[*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) a row of docs (doc_id, text)."""
    name = model_file(docs.sparkSession, model)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for b in blocks(batches, "text"):
            ids = vocab.encode(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(" ".join(map(str, i.tolist())).encode()).hexdigest() for i in ids]), pa.array([hashlib.sha256(vocab.decode(i).encode()).hexdigest() for i in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model)
