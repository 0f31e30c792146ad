"""Token counts behind a digest cache: stored counts are joined by digests of content and tokenizer, and only distinct misses are encoded.

The cache is a folder of Parquet tables (digest, n_tokens), one sub-folder for each version of a tokenizer (a digest of its file, its options and
its library) and within that one for each append. A run digests all texts, looks the distinct digests up, encodes one text for each that the cache lacks,
appends these counts, and joins them to all rows. A failed run leaves no half append: Spark commits a batch as a whole, and batches
without that mark are not read.

Content is normalised only as far as the tokenizer cannot see: where its file says that blanks become one blank and are then dropped, runs of ASCII
blanks become one and the text is trimmed. (Case and Unicode forms stay: its special strings are looked for before it normalises.) Such a tokenizer never
joins what a blank parts, so a task encodes each distinct word once and adds up; other tokenizers get whole texts.

The tokenizer's file is read by the driver and sent to the tasks; its size doesn't depend on the data.

Defined cases: null text is empty, 0 bytes and 0 tokens. Rows with equal or null ids are counted each alone. Texts of any length are counted whole.
A digest that two appends hold counts once. No rows: no result, nothing appended. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import folder
from .shared import stored, table

TOKEN_LIMIT = 2048
#: Words that a task keeps the counts of, and the longest such word.
WORDS, WORD_CHARS = 400_000, 64
_COUNTED = "digest binary, n_tokens long"


class Model:
    """A tokenizer's file and how its texts may be normalised and cut. .json: tokenizers; .model: sentencepiece."""

    def __init__(self, path: str):
        import sentencepiece
        import tokenizers

        with open(path, "rb") as f:
            self.data = f.read()
        self.json = path.endswith(".json")
        spec = json.loads(self.data) if self.json else {}
        steps = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
        to_blank = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in steps)
        drops = bool(cuts) and cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
        self.blanks = to_blank and drops and "\\s|" not in json.dumps(cuts[0]) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", []))
        library = f"tokenizers {tokenizers.__version__}" if self.json else f"sentencepiece {sentencepiece.__version__}"
        self.version = hashlib.sha256(self.data + f"|{library}|blanks {self.blanks}|no special tokens added".encode()).hexdigest()

    def counter(self):
        """A function from a list of texts to their numbers of tokens."""
        if not self.json:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(self.data.decode())
        encoder.no_truncation()
        encoder.no_padding()
        return lambda texts: [len(x.ids) for x in encoder.encode_batch_fast(texts, add_special_tokens=False)]


def content(text: Column, blanks: bool) -> Column:
    """The text as far as the tokenizer sees it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if blanks else text


def digest(text: Column, blanks: bool) -> Column:
    return F.unhex(F.sha2(content(text, blanks), 256))


def _encode(model: Model, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = model.counter(), {"": 0}

        def by_words(text: str) -> int:
            words = text.split(" ")
            new = list({w for w in words if w not in known})
            if new:
                if len(known) > kept:
                    known.clear()
                    known[""] = 0
                    new = list(set(words) - {""})
                found = dict(zip(new, count(new), strict=True))
                known.update((w, n) for w, n in found.items() if len(w) <= WORD_CHARS)
                return sum(known[w] if w in known else found[w] for w in words)
            return sum(map(known.__getitem__, words))

        for batch in batches:
            texts = batch.column(1)
            n = [by_words(x.as_py()) if model.blanks else count([x.as_py()])[0] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def _appended(spark: SparkSession, folder: str) -> list[str]:
    """The committed batches in a folder of the cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    batches = [x.getPath() for x in files.listStatus(path)]
    done = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")
    return sorted(x.toString() for x in batches if files.exists(done(x)))


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of all batches of a version, a digest once; None where there are none."""
    batches = _appended(spark, f"{cache}/version={version}")
    return spark.read.schema(_COUNTED).parquet(*batches).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")) if batches else None


def encode_misses(texts: DataFrame, model: Model, cache: str, kept: int = WORDS) -> DataFrame:
    """Encodes one text for each digest of (digest, content), and appends the counts to the cache; the batch as a frame."""
    spark = texts.sparkSession
    one = texts.groupBy("digest").agg(F.first("content").alias("content"))  # copies meet in their map task first
    path = f"{cache}/version={model.version}/batch={uuid.uuid4().hex}"
    one.mapInArrow(_encode(model, kept), _COUNTED).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_COUNTED).parquet(path)


def count_tokens(docs: DataFrame, model: Model, cache: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, digest, n_tokens, over_limit) of each row; the cache then holds the counts of all its texts."""
    spark, text = docs.sparkSession, F.col("text")
    keyed = stored(docs.select("doc_id", F.octet_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("n_bytes"), digest(text, model.blanks).alias("digest")), "digests")
    texts = docs.select(digest(text, model.blanks).alias("digest"), content(text, model.blanks).alias("content"))
    before = cached(spark, cache, model.version)
    if before is None:
        counts = encode_misses(texts, model, cache)
    else:
        asked = stored(keyed.select("digest").distinct().join(before, "digest", "left"), "asked")
        missed = stored(asked.where("n_tokens is null").select("digest"), "missed")  # its size is known then: if small, no text is shuffled to find its text
        known = asked.where("n_tokens is not null")
        counts = known if missed.isEmpty() else stored(known.unionByName(encode_misses(texts.join(missed, "digest", "left_semi"), model, cache)), "counts")
    out = keyed.join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "digest", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def load(spark: SparkSession) -> Model:
    """The tokenizer that spark.netquarry.tokens.model names, by default the word tokenizer of the public files."""
    path = spark.conf.get("spark.netquarry.tokens.model", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Model(path)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder in spark.netquarry.tokens.cache; where that is unset, each run begins an empty one, so that nothing a run does is owed to an earlier one."""
    cache = spark.conf.get("spark.netquarry.tokens.cache", None) or f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), load(spark), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")
