"""A stored index of words: which works hold a word, and how often. Counts, forms of headwords and the works that a search must read come from it, not
from a scan of the corpus.

A row of postings is one word as written and one page of PAGE work ids: offsets of ids within the page and counts. So no row grows with the corpus,
however common its word. Rows lie in BUCKETS folders by a hash of the word, sorted by it within files, so that looking up words opens their folders
only. Each build adds a segment with the works whose text is new or changed, told by digests; a table of works says which segment holds a work now,
and rows of other segments no longer count for it. Whether anything changed at all is told by the files' names, sizes and times. Beyond MOST_SEGMENTS all is built anew. A version
is found once its last table is whole, so a build that breaks off leaves the one before.

Defined results: rows of one id are one work, those without an id too, and they are read by every search. Null texts hold nothing. An empty table has an empty index."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus, interim

PAGE = 4096
BUCKETS = 64
MOST_SEGMENTS = 8
#: Ids and files up to these numbers are filters of the scan, which Parquet prunes by; more ids are joined.
MOST_IDS, MOST_FILES = 500, 500
#: Ids up to this number (about 20 bytes each) are broadcast.
MOST_BROADCAST_IDS = 1_000_000
#: A search that must read more than this share of the works reads them all.
MOST_SHARE = 0.6


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def digest(*columns: str) -> Column:
    """An aggregate: one number for a bag of rows, whatever their order."""
    h = F.xxhash64(*columns)
    return F.xxhash64(F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.count("*"))


class WordIndex:
    """The index of one documents table. `docs` as it lies on disk, `root` the index's folder in the shared one."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None):
        self.spark = spark
        self.docs = corpus.table(spark, sf_dir, "documents")
        self.root = root or f"{interim.folder(spark)}/word_index-{hashlib.md5(sf_dir.encode()).hexdigest()[:16]}"
        self.version: int | None = None
        self.segments: list[int] = []
        self.files, self.size = 0, 0
        self.dirty = False  # whether some segment holds works that have changed or gone since
        self._open()

    # ---- versions

    def _open(self) -> None:
        done = [int(name.split("=")[1]) for name in interim.children(self.spark, self.root) if name.startswith("version=") and interim.exists(self.spark, f"{self.root}/{name}/state/_SUCCESS")]
        if done:
            self.version = max(done)
            state = self.spark.read.parquet(f"{self._at()}/state").first()
            self.segments, self.dirty, self.files, self.size = list(state.segments), state.dirty, state.files, state.size

    def _at(self) -> str:
        return f"{self.root}/version={self.version}"

    def works(self) -> DataFrame:
        """work_id, digest, segment, files."""
        return self.spark.read.parquet(f"{self._at()}/works")

    def _files_now(self) -> int:
        """One number for the names, sizes and times of the table's files: only footers are read."""
        files = self.docs.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("long").alias("file_time")).distinct()
        return files.agg(F.coalesce(digest("file_path", "file_size", "file_time"), F.lit(0)).alias("d")).first().d

    def up_to_date(self) -> bool:
        return self.version is not None and self._files_now() == self.files

    def refresh(self) -> dict[str, int]:
        """Brings the index up to date. How many works were indexed, kept and removed."""
        if self.up_to_date():
            return {"indexed": 0, "kept": self.size, "removed": 0}
        files = self._files_now()
        found = self.docs.groupBy(F.col("doc_id").cast("long").alias("work_id")).agg(digest("text").alias("digest"), F.sort_array(F.collect_set("_metadata.file_path")).alias("files"))
        found = interim.written(found, "work_digests")
        fresh = self.version is None or len(self.segments) >= MOST_SEGMENTS
        old = self.spark.createDataFrame([], "work_id long, digest long, segment int") if fresh else self.works().select("work_id", "digest", "segment")
        segment = 1 + max(self.segments, default=0)
        old_ = old.select(F.col("work_id").alias("old_id"), F.col("digest").alias("old_digest"), "segment")
        same = F.col("work_id").eqNullSafe(F.col("old_id")) & (F.col("digest") == F.col("old_digest"))
        works = interim.written(found.join(old_, same, "left").select("work_id", "digest", "files", F.coalesce("segment", F.lit(segment)).alias("segment")), "work_segments")
        todo = works.where(F.col("segment") == segment).select("work_id")
        indexed, kept = todo.count(), works.where(F.col("segment") != segment).count()
        removed = (0 if fresh else old.count()) - kept
        if indexed:
            docs = self.docs if not kept else self.docs.join(F.broadcast(todo) if indexed <= MOST_BROADCAST_IDS else todo, self.docs.doc_id.eqNullSafe(todo.work_id), "left_semi")
            _postings(docs).write.partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")
        before = self.version
        self.version = 1 + (self.version or 0)
        works.write.parquet(f"{self._at()}/works")
        self.segments, self.dirty = sorted({*([] if fresh else self.segments), *([segment] if indexed else [])}), (False if fresh else self.dirty or removed > 0)
        self.files, self.size = files, indexed + kept
        state = self.spark.createDataFrame([(self.segments, self.dirty, self.files, self.size)], "segments array<int>, dirty boolean, files long, size long")
        state.coalesce(1).write.parquet(f"{self._at()}/state")
        if before is not None:  # readers of the version before may still be at work; older ones go
            for name in interim.children(self.spark, self.root):
                if name.startswith("version=") and int(name.split("=")[1]) < before:
                    interim.delete(self.spark, f"{self.root}/{name}")
        return {"indexed": indexed, "kept": kept, "removed": removed}

    # ---- look-ups

    def _rows(self, words: list[str] | None) -> DataFrame:
        schema = "word string, raw string, page long, offsets array<int>, counts array<int>, bucket int"
        found = None
        for segment in self.segments:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/postings/segment={segment}")
            if words is not None:
                rows = rows.where(F.col("bucket").isin(sorted(set(map(bucket, words)))) & F.col("word").isin(words))
            rows = rows.withColumn("segment", F.lit(segment))
            found = rows if found is None else found.unionByName(rows)
        return found if found is not None else self.spark.createDataFrame([], schema + ", segment int")

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """word, raw (as written, in lower case), work_id, n: of some words, or of all."""
        rows = self._rows(words).select("word", "raw", "segment", "page", F.explode(F.arrays_zip("offsets", "counts")).alias("x"))
        rows = rows.select("word", "raw", (F.col("page") * PAGE + F.col("x.offsets")).alias("work_id"), F.col("x.counts").alias("n"), "segment")
        if self.dirty:
            now = self.works().select(F.col("work_id").alias("now_id"), F.col("segment").alias("now_segment"))
            rows = rows.join(now, F.col("work_id").eqNullSafe(F.col("now_id")) & (F.col("segment") == F.col("now_segment")), "left_semi")
        return rows.select("word", "raw", "work_id", "n")

    def counts(self, words: list[str] | None = None, by: str = "word") -> DataFrame:
        """by (word or raw), n, works: occurrences, and how many works hold it."""
        if self.dirty or by == "word":  # a word may be written in several ways in one work
            rows = self.postings(words).groupBy(by, "work_id").agg(F.sum("n").alias("n"))
            return rows.groupBy(by).agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("works"))
        return self._rows(words).groupBy(by).agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"), F.sum(F.size("offsets")).alias("works"))

    def totals(self, words: list[str] | None = None) -> DataFrame:
        """word, n: sums within rows where nothing was changed, so that no posting is unfolded."""
        if self.dirty:
            return self.postings(words).groupBy("word").agg(F.sum("n").alias("n"))
        return self._rows(words).groupBy("word").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))

    def known(self, words: list[str]) -> list[str]:
        """Those of some words that occur: as many rows at most."""
        return sorted(r.word for r in self.totals(words).select("word").collect()) if words else []

    def holding(self, words: list[str]) -> DataFrame:
        """work_id of the works that hold any of some words."""
        return self.postings(words).select("work_id").distinct()

    def docs_holding(self, *groups: list[str]) -> DataFrame:
        """The documents that hold a word of every group: files and ids that Parquet can prune by where they are few, a semi-join beyond."""
        ids = None
        for words in groups:
            own = self.holding(words)
            ids = own if ids is None else ids.join(own, "work_id", "left_semi")
        ids = interim.written(ids, "holding")
        count = ids.count()
        if count > MOST_SHARE * self.size:
            return self.docs
        some = F.broadcast(ids) if count <= MOST_BROADCAST_IDS else ids
        docs = self._in_files(self.works().join(some, "work_id"))
        if count <= MOST_IDS:
            docs = docs.where(F.col("doc_id").isin([r.work_id for r in ids.where("work_id is not null").collect()]))
        else:
            docs = docs.join(some, docs.doc_id == ids.work_id, "left_semi")
        nameless = self.works().where("work_id is null")
        return docs if nameless.isEmpty() else docs.unionByName(self._in_files(nameless).where("doc_id is null"))

    def _in_files(self, works: DataFrame) -> DataFrame:
        """The table's files that hold some works, as long as they are few enough to name."""
        files = [r.f for r in works.select(F.explode("files").alias("f")).distinct().limit(MOST_FILES + 1).collect()]
        return self.docs.where(F.col("_metadata.file_path").isin(files)) if len(files) <= MOST_FILES else self.docs


def _postings(docs: DataFrame) -> DataFrame:
    """Rows as they are stored. What a word is in an index is worked out once for each page, not for each token, but in lines that may hold elisions."""
    line = F.col("line")
    plain = F.transform(T.tokens(F.lower(line)), lambda w: F.struct(w.alias("raw"), F.lit(None).cast("string").alias("word")))
    lines = docs.select(F.col("doc_id").cast("long").alias("work_id"), F.explode(F.split("text", corpus.LINE_BREAK)).alias("line"))
    rows = lines.select("work_id", F.explode(F.when(T.may_elide(line), T.index_pairs(line)).otherwise(plain)).alias("t")).groupBy("t.word", "t.raw", "work_id").agg(F.count("*").cast("int").alias("n"))
    page = F.floor(F.col("work_id") / PAGE)
    rows = rows.groupBy("word", "raw", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("work_id", "n"))).alias("x"))  # PAGE entries at most
    rows = rows.select(F.coalesce("word", T.index_form(F.col("raw"))).alias("word"), "raw", "page", F.transform("x", lambda x: (x["work_id"] - F.col("page") * PAGE).cast("int")).alias("offsets"), F.transform("x", lambda x: x["n"]).alias("counts"))
    rows = rows.withColumn("bucket", (F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int"))
    rows = interim.written(rows, "postings")  # ranges are told from a sample, which would count all words again
    return rows.repartitionByRange("bucket", "word", "raw", "page").sortWithinPartitions("bucket", "word", "raw", "page")
