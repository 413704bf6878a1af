"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokens of both tokenizers of many texts are one flat list with byte ends. Every token points to the farthest-right
token that overlaps it; doubling the pointers ends at the last token of each component, which labels the group. Texts are
taken in chunks of bounded size. How often two ids overlap in the whole corpus is a table by pair: a chunk
sends each of its pairs once and gets the counts of just these back; its texts meet them in one bounded group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.text import staged
from querymill.llm.tokencount import PATTERN

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that a chunk takes; a longer text is a chunk of its own.
CHUNK = 500_000
WIDTH = 1 << 20
#: Rows of texts and, apart, of a chunk's pairs (place, pair and number).
ROWS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, links binary, place int, pair long, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies spell bytes with: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spelled(ids: int) -> list[np.ndarray]:
    """Per separator, every id followed by it, in texts of fixed width."""
    width = len(str(ids)) + 1
    return [np.array([b"%d%s" % (i, sep) for i in range(ids)], f"S{width}") for sep in (b",", b"|", b";")]


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if i not in special}
        # ids of this vocabulary stand in the order of its merges, so they serve as ranks
        self.encoder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.a[i] = entry
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(self.pieces.get_piece_size())
        self.b = [bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        ids = max(len(self.a), len(self.b))
        self.spelled = np.concatenate(_spelled(ids))
        self.ids = ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.encoder.encode_ordinary(" " + t) for t in texts], self.pieces.encode(texts, num_threads=1)

    def agree(self, text: str, a: list[int], b: list[int]) -> bool:
        """Do both spell a space and the text?"""
        want = b" " + text.encode()
        return b"".join(map(self.a.__getitem__, a)) == want and b"".join(map(self.b.__getitem__, b)) == want


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of A and B over the same bytes, and each byte's token -> per token the place (among B's) of its group's last token.

    Every token points to the overlapping token that reaches farthest right: of A to the token of B that holds its last byte, of B to
    that of A if that one ends later. Pointers are doubled until they stand still.
    """
    nb = len(ends_b)
    last = own_a[ends_b - 1]
    to = np.concatenate([np.where(ends_a[last] > ends_b, nb + last, np.arange(nb, dtype=np.int32)), own_b[ends_a - 1]])
    while True:
        then = to[to]
        if (then == to).all():
            return to[nb:], to[:nb]
        to = then


def aligned(t: Tokenizers, doc_ids: list, texts: list[str | None]) -> dict:
    """A chunk: counts and digests per text, its links as places among the chunk's distinct pairs, and how often each pair is linked."""
    n = len(texts)
    n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
    sha = [""] * n
    place = [i for i, x in enumerate(texts) if x]
    all_a, all_b = t.encode([texts[i] for i in place])
    kept = [k for k, i in enumerate(place) if t.agree(texts[i], all_a[k], all_b[k])]
    done = {"doc_id": doc_ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "sha": sha}
    if not kept:
        return done | {"links": b"", "pairs": np.zeros(0, np.int64), "counts": np.zeros(0, np.int64)}
    at = np.array([place[k] for k in kept])
    many_a, many_b = (np.array([len(side[k]) for k in kept]) for side in (all_a, all_b))
    a, b = (np.concatenate([np.asarray(side[k], np.int32) for k in kept]) for side in (all_a, all_b))
    del all_a, all_b
    size_a, size_b = t.size_a[a], t.size_b[b]
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    own_a, own_b = (np.repeat(np.arange(len(x), dtype=np.int32), n) for x, n in ((a, size_a), (b, size_b)))
    label_a, label_b = group_labels(ends_a, ends_b, own_a, own_b)
    # texts lie end to end: both sides end together, so no group reaches across
    border_a, border_b = np.cumsum(many_a), np.cumsum(many_b)
    is_last = label_b == np.arange(len(b))
    groups = np.concatenate([[0], np.cumsum(is_last)])
    n_a[at], n_b[at] = many_a, many_b
    n_groups[at] = np.diff(np.concatenate([[0], groups[border_b]]))
    # tokens of a group side by side, A before B, each spelled with what follows it
    in_group_a, in_group_b = groups[label_a], groups[:-1]
    spot_a = np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(is_last) + 1])[in_group_a]
    spot_b = np.arange(len(b)) + np.cumsum(np.bincount(in_group_a))[in_group_b]
    ends_group = np.append(label_a[1:] != label_a[:-1], True)
    spelled = np.empty(len(a) + len(b), np.int32)
    spelled[spot_a] = a + np.where(ends_group, t.ids, 0)
    spelled[spot_b] = b + np.where(is_last, 2 * t.ids, 0)
    flat, width = t.spelled[spelled].tobytes(), t.spelled.itemsize
    begin = 0
    for i, end in zip(at.tolist(), (border_a + border_b).tolist()):
        # the separator behind the last group goes
        said = flat[begin * width : end * width].translate(None, b"\0")[:-1]
        sha[i] = hashlib.sha256(said).hexdigest()
        begin = end
    first = own_b[ends_a - size_a]
    each = own_b[ends_a - 1] - first + 1
    before = np.cumsum(each) - each
    met = np.repeat(first - before, each) + np.arange(each.sum())
    pairs, which, counts = np.unique(np.repeat(a, each) * np.int64(WIDTH) + b[met], return_inverse=True, return_counts=True)
    n_links[at] = np.add.reduceat(each, np.concatenate([[0], border_a[:-1]]))
    return done | {"links": packed_links(which, n_links[at]), "pairs": pairs, "counts": counts.astype(np.int64)}


def packed_links(which: np.ndarray, lengths: np.ndarray) -> bytes:
    """Places sorted within each text and kept as differences, which compress well."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    key = np.sort(text * (1 << 32) + which)
    which = key & 0xFFFFFFFF
    step = np.diff(which, prepend=0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    step[starts] = which[starts]
    return step.astype("<u4").tobytes()


def unpacked_links(data: bytes, lengths: np.ndarray) -> np.ndarray:
    step = np.frombuffer(data, "<u4").astype(np.int64)
    total = np.cumsum(step)
    starts = np.cumsum(lengths) - lengths
    before = np.where(starts > 0, total[starts - 1], 0) if len(step) else starts
    return total - np.repeat(before, lengths)


def chunker(path_a: str, path_b: str, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> per chunk a row for each text and a row for each distinct pair (ROWS). Rows stay small, whatever the chunk."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ROWS.split(", "))])

    def rows(size: int, known: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(size, f.type) for f in schema], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0

        def made() -> Iterator[pa.RecordBatch]:
            found = aligned(t, ids, texts)
            ends = np.concatenate([[0], 4 * np.cumsum(found["n_links"])]).astype(np.int32)
            links = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(found["links"])])
            counts = {c: pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")}
            yield rows(len(ids), {"chunk": pa.array([number] * len(ids)), "doc_id": pa.array(ids, pa.int64()), **counts, "sha": pa.array(found["sha"]), "links": links})
            many = len(found["pairs"])
            if many:
                yield rows(many, {"chunk": pa.array([number] * many), "place": pa.array(np.arange(many, dtype=np.int32)), "pair": pa.array(found["pairs"]), "n": pa.array(found["counts"])})

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if ids and size + len(text or "") > chunk:
                    yield from made()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text or "")
        if ids:
            yield from made()

    return cut


def summed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Texts of a chunk and the corpus counts of its pairs -> RESULT."""
    pairs = pairs.sort_by("place")
    total, best = np.asarray(pairs["total"]), np.asarray(pairs["best"])
    lengths = np.asarray(texts["n_links"], np.int64)
    n_best, count_sum = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if lengths.sum():
        links = unpacked_links(b"".join(texts["links"].to_pylist()), lengths)
        starts, used = (np.cumsum(lengths) - lengths)[lengths > 0], lengths > 0
        count_sum[used] = np.add.reduceat(total[links], starts)
        n_best[used] = np.add.reduceat(best[links], starts)
    columns = [*(texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), texts["sha"]]
    return pa.table(dict(zip((f.split()[0] for f in RESULT.split(", ")), columns)))


def align(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) -> RESULT, a row for every row of docs.

    Null and empty texts, and texts that one of the tokenizers does not spell back byte by byte, have zeros and an empty
    digest. Repeated rows count as often as they stand; other columns do not matter. The vocabulary files must be at the same paths on all executors.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(chunker(path_a, path_b, chunk), ROWS)
    rows = staged(rows, "chunks")
    each = rows.filter("pair IS NOT NULL").select("chunk", "place", "pair", "n")
    totals = each.groupBy("pair").agg(F.sum("n").alias("total"))
    # ids of A linked with one id of B: no more than A's vocabulary
    of_b = Window.partitionBy(F.col("pair") % WIDTH)
    ranked = staged(totals.withColumn("best", (F.col("total") == F.max("total").over(of_b)).cast("long")), "pair-counts")
    told = each.select("chunk", "place", "pair").join(ranked, "pair").select(F.col("chunk").alias("c"), "place", "total", "best")
    texts = rows.filter("pair IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "links")
    # new names keep the columns of both sides apart
    texts = texts.select(*[F.col(c).alias(c) for c in texts.columns])
    return texts.groupBy("chunk").cogroup(told.groupBy("c")).applyInArrow(summed, RESULT)
