"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, kneser_ney, licences, merkle, mixing, neighbours, packing, pii, repeats, superminhash, tiff, toxicity, vector_codes
from .common import as_bytes, table


def fold(column: str, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under a model learned from four of the five folds of the ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = kneser_ney.train(docs.where(fold("doc_id", 5) != 1))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the texts whose sets of 3-word shingles are similar to nine tenths."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and label of the four folds of the ids that are learned from."""
    return table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity score and the decision at one half."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = toxicity.score(docs, toxicity.fit(docs, toxic_labels(spark, sf_dir)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stored_as(data: bytes) -> bytes:
    """A TIFF file of rows of 64 samples. What the bytes are decides on scheme, predictor, strips or tiles, and one page or two."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, 64)
    code = zlib.crc32(data)
    half = len(rows) // 2 if code & 16 and len(rows) > 1 else len(rows)
    pages = [p for p in (rows[:half], rows[half:]) if len(p)]
    method = (tiff.DEFLATE, tiff.LZW, tiff.PACKBITS, tiff.NONE)[code & 3]
    return tiff.write_tiff(pages, method, 2 if code & 4 else 1, 16, 32 if code & 8 else None)


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the pages of a TIFF file, read back by ``tiff_pages``."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, sizes, media = batch.column(0).slice(i, 256), [], []
                for text in batch.column(1).slice(i, 256):
                    data = as_bytes(text.as_py())
                    sizes.append(len(data))
                    media.append(stored_as(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    def digest(pixels: bytes) -> tuple:
        a = np.frombuffer(pixels, dtype=np.uint8)
        bins = np.bincount(a >> 5, minlength=8)
        edges = int(np.abs(np.diff(a.astype(np.int16))).sum())
        feature = f"sum={int(a.sum(dtype=np.int64))};edges={edges};bins=" + ",".join(map(str, bins))
        return len(a), hashlib.sha256(pixels).hexdigest(), zlib.crc32(a[-64:].tobytes()), feature

    kept, made = ["doc_id", "n_bytes", "media_bytes", "media_sha256"], ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per file from the rows of its pages, which a task has one after the other."""
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
        own, parts, first, out = None, [], None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [*kept, *made, "pages", "layout"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
                if row[4] == 0 and own is not None:
                    out.append((*own, *digest(b"".join(parts)), len(parts), first))
                    parts = []
                if row[4] == 0:
                    own, first = row[:4], f"scheme={row[5]};predictor={row[6]}"
                parts.append(row[7].as_py())
            yield flush()
            out = []
        if own is not None:
            out.append((*own, *digest(b"".join(parts)), len(parts), first))
            yield flush()

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")
    files = files.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.tiff_pages(files, "media", kept).select(*kept, "page", "compression", "predictor", "pixels")
    return pages.mapInArrow(payloads, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, pages int, layout string").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "layout"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 4096."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of the sources takes, and at which time of its schedule first."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that the trained classifier takes for a licence notice."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return licences.scan(docs, licences.train(docs))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base spans, and those that bootstrapped contexts add."""
    return pii.report(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 400-byte strings that begin elsewhere too, and how many passages others share."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text, starts, ends, shared in zip(*batch.columns[1:5]):
                data, left = as_bytes(text.as_py()), hashlib.sha256()
                at = removed = 0
                starts, ends = starts.as_py() or [], ends.as_py() or []
                for start, end in zip(starts, ends):
                    left.update(data[at:start])
                    at, removed = end, removed + end - start
                left.update(data[at:])
                for values, value in zip(out, (len(data), removed, len(starts), left.hexdigest(), len(shared.as_py() or []))):
                    values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    found = repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "starts", "ends", "shared_starts")
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by sets of 4-word shingles that share eight tenths: their components, and which one stays."""
    return superminhash.join(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all rows, and what it says of them after a part was tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code under learned codebooks, and its error."""
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_scoring": op1_lm_scoring, "op2_jaccard_join": op2_jaccard_join, "op3_toxicity": op3_toxicity, "op4_tiff": op4_tiff, "op5_packing": op5_packing, "op6_mixing": op6_mixing, "op7_neighbours": op7_neighbours, "op8_licences": op8_licences, "op9_pii": op9_pii, "op10_repeats": op10_repeats, "op11_superminhash": op11_superminhash, "op12_merkle": op12_merkle, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.OP6_SQL, "op12_merkle": merkle.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
