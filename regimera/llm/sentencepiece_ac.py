"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The text gets the dummy prefix and its spaces become the meta symbol. The automaton reads each character once; its
output links list every piece that ends there, and each relaxes the best score at that position. A character that no
piece covers falls back to its UTF-8 byte pieces, which cost BYTE_MARGIN more than the least likely piece. Where no piece holds
the meta symbol after another character, the best split of a text is the best splits of its runs "spaces + word" in turn;
those are kept in a bounded memo. A model with such pieces is split text by text. Ties go to the longer last piece. A model's own
normaliser (such as NFKC) is not applied: texts are encoded as they are, so decoding gives them back.

Scores: a unigram model's own log-probabilities. The vocabulary at hand is a merge (BPE) model, whose scores are merge
ranks, so log-probabilities are taken from the place in merge order by Zipf's law: -ln(place + 3). Decoding inverts encoding for every
text: a literal meta symbol is encoded as bytes.

Rows are independent: no shuffle; the pieces are broadcast (their size is the vocabulary's). Cases: a null or empty text
encodes to no pieces and decodes to the empty text; repeated rows are encoded each; an empty table gives an empty
result; the memory for a text is proportional to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

META = "▁"
MEMO_CHUNKS = 200_000
BYTE_MARGIN = 10.0
_RUN = re.compile(" *[^ ]+| +")


def load_pieces(path: str) -> dict:
    """Pieces, scores and byte pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores, byte_ids = [], [], [-1] * 256
    raw = [model.get_score(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    place = {i: k for k, i in enumerate(plain)}
    ranks = all(float(raw[i]).is_integer() for i in plain)  # merge ranks, not log-probabilities
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        pieces.append(name)
        scores.append((-math.log(3 + place[i]) if ranks else raw[i]) if i in place else None)
    return {"pieces": pieces, "scores": scores, "bytes": byte_ids, "unknown": model.unk_id()}


class Codec(dict):
    """run of text -> ids as little-endian int32 bytes, computed on demand; the memo is emptied when full."""

    def __init__(self, model: dict, memo: int = MEMO_CHUNKS):
        super().__init__()
        self.memo, self.byte_ids, self.unknown = memo, model["bytes"], model["unknown"]
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(zip(model["pieces"], model["scores"])):
            if score is not None and piece:
                self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.raw = [p.replace(META, " ").encode() if s is not None else b"" for p, s in zip(model["pieces"], model["scores"])]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.raw[i] = bytes([b])
        self.by_run = not any(META in p.lstrip(META) for p, s in zip(model["pieces"], model["scores"]) if s is not None)
        self.byte_cost = min((s for s in model["scores"] if s is not None), default=0.0) - BYTE_MARGIN

    def __missing__(self, run: str) -> bytes:
        ids = np.array(self.best(run), "<i4").tobytes()
        if len(self) >= self.memo:
            self.clear()
        self[run] = ids
        return ids

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unknown for b in c.encode("utf-8", "surrogatepass")]

    def best(self, run: str) -> list[int]:
        """Ids of the best split of a run in which spaces are still spaces."""
        literal = META in run
        text = (run.replace(META, "\0") if literal else run).replace(" ", META)
        n, byte_cost = len(text), self.byte_cost
        score, piece, size = [0.0] + [-math.inf] * n, [-1] * (n + 1), [1] * (n + 1)
        done = 0
        for end, (length, i, value) in self.automaton.iter(text):
            while done < end:  # positions before this end get no more pieces
                done += 1
                if score[done] < (fall := score[done - 1] + byte_cost):
                    score[done], piece[done], size[done] = fall, -1, 1
            now = score[end + 1 - length] + value
            if now > score[end + 1] or now == score[end + 1] and length > size[end + 1]:
                score[end + 1], piece[end + 1], size[end + 1] = now, i, length
        while done < n:
            done += 1
            if score[done] < (fall := score[done - 1] + byte_cost):
                score[done], piece[done], size[done] = fall, -1, 1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                c = text[at - 1]
                out.extend(reversed(self._bytes(META if literal and c == "\0" and run[at - 1] == META else c if c != META else " ")))
            at -= size[at]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if not self.by_run:
            return np.array(self.best(" " + text), "<i4")
        return np.frombuffer(b"".join(map(self.__getitem__, _RUN.findall(" " + text))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


_last: list = [None, 0, None]


def codec_of(shared, memo: int = MEMO_CHUNKS) -> Codec:
    """One codec for a broadcast model in a worker process, which outlives its tasks; only the last is kept."""
    if _last[0] is not shared.value or _last[1] != memo:
        _last[:] = [shared.value, memo, Codec(shared.value, memo)]
    return _last[2]


def encode(docs: DataFrame, model: dict, memo: int = MEMO_CHUNKS) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, memo)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a bounded number of ids in memory at once
                ids, start = [], at
                total = 0
                while at < batch.num_rows and total < 1 << 20:
                    ids.append(codec.encode(batch.column(1)[at].as_py()))
                    total += len(ids[-1])
                    at += 1
                cut = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:at], lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            texts = [codec.decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


DIGEST = "doc_id bigint, n_chars bigint, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean"


def digest(docs: DataFrame, model: dict, memo: int = MEMO_CHUNKS) -> DataFrame:
    """Encodes and decodes each whole text: piece counts, the digest of the ids (little-endian int32), and whether the text came back."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, memo)
        fallback = np.zeros(len(codec.raw), bool)
        fallback[[i for i in codec.byte_ids if i >= 0]] = True
        for batch in batches:
            rows = []
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = cell.as_py() or ""
                ids = codec.encode(text)
                rows.append((key, len(text), len(ids), int(fallback[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), codec.decode(ids) == text))
            columns = list(zip(*rows)) if rows else [[]] * 6
            i, s = pa.int64(), pa.string()
            names = ["doc_id", "n_chars", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (i, i, i, i, s, pa.bool_()))], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, DIGEST)
