"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes holds inserts, deletes and revised counts. It is summed to one small row for each key and becomes the next
entry of a numbered log: a folder that is written aside and gets its number by one rename when it is finished. Two
drivers can't take one number, so every commit is judged against exactly the entries before it, and the loser of a race is
judged again. Totals are the sums over the log, so they are additive, and a batch that is committed again (after a failure,
or by mistake) changes nothing. A compaction sums the log up to an entry, and holds the ids of its batches as a table that commits
look their own up in. Changes are pre-aggregated before they are shuffled, so a key that holds most rows costs a row for each task.

Defined cases: a null text has 0 tokens; null sources, languages and versions are keys of their own; a null count is 0;
an unknown kind of change and a delete of what was never inserted are errors; repeated rows count each; a key whose totals are all zero is left out; an empty
batch is committed and empty; an empty rollup gives an empty result; other columns take no part.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.staging import new_path, staged
from tallyloom.llm.tokens import tokenizer_path, word_tokenizer
from tallyloom.sources.versions import Folder

KEYS = ("source", "lang", "version")
SUMS = "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang and tokens of every row."""
    where = path or tokenizer_path()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(word_tokenizer(where).counts(texts), pa.int64())

    counted = F.arrow_udf(run, "long")
    return docs.select("doc_id", "source", "lang", counted(F.col("text")).alias("tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key of changes (kind, source, lang, version, tokens, old_tokens)."""
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null"))))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(wrong.cast("int"))
    signed = F.when(F.col("kind") == "insert", tokens).when(F.col("kind") == "delete", -tokens).otherwise(tokens - old)
    sums = changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(signed).cast("long").alias("tokens"))
    return sums.filter("docs <> 0 or tokens <> 0")


class State(NamedTuple):
    """What one look at a rollup found: the entry up to which the last compaction sums (0: none), and (number, batch) of the log."""

    upto: int
    log: list[tuple[int, str]]

    @property
    def last(self) -> int:
        return max([self.upto, *(n for n, _ in self.log)])


#: Milliseconds that what a compaction replaced stays for those who read it; longer than any read or commit takes.
GRACE_MS = 6 * 3600 * 1000


class Rollup:
    """A folder with the log of batches (log/<number>/id=<batch>) and its compactions (upto/<number>)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path

    def _state(self) -> State:
        """One look; compactions come first, so whatever one sums that is published in between is in the log as well."""
        upto = max((int(name) for name, _ in self.folder.entries("upto")), default=0)
        found = [p.split("/")[-2:] for p in self.folder.matching("log/*/id=*")]
        return State(upto, sorted((int(n), unquote(batch[3:])) for n, batch in found))

    def _sums(self, state: State) -> DataFrame:
        """The deltas that make up the totals of a state."""
        folders = [f"upto/{state.upto:012d}/sums"] if state.upto else []
        folders += [f"log/{n:012d}/id={quote(batch, safe='')}" for n, batch in state.log if n > state.upto]
        if not folders:
            return self.spark.createDataFrame([], SUMS)
        return self.spark.read.schema(SUMS).parquet(*[f"{self.path}/{f}" for f in folders])

    def _names(self, state: State) -> DataFrame:
        """Ids of the batches that the last compaction sums."""
        if not state.upto:
            return self.spark.createDataFrame([], "name string")
        return self.spark.read.schema("name string").parquet(f"{self.path}/upto/{state.upto:012d}/names")

    def _committed(self, state: State, batch_id: str) -> bool:
        return any(batch == batch_id for _, batch in state.log) or not self._names(state).filter(F.col("name") == batch_id).isEmpty()

    def _publish(self, parts: dict[str, DataFrame], name: str) -> bool:
        """Writes tables into a new folder and gives it its name; False if the name is taken."""
        fresh = f"new/{uuid.uuid4().hex}"
        for part, rows in parts.items():
            rows.coalesce(1).write.parquet(f"{self.path}/{fresh}/{part}")
        return self.folder.claim(fresh, name)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was committed before. A batch that would make a total negative is an error."""
        state = self._state()
        if self._committed(state, batch_id):
            return False
        sums = staged(deltas(changes), "deltas")
        while True:
            both = self._sums(state).withColumn("fresh", F.lit(False)).unionByName(sums.withColumn("fresh", F.lit(True))).groupBy(*KEYS)
            after = both.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.bool_or("fresh").alias("fresh"))
            wrong = after.filter("fresh and (docs < 0 or tokens < 0)").drop("fresh").take(1)
            if wrong:
                raise ValueError(f"batch {batch_id} takes away what isn't there: {wrong[0].asDict()}")
            self.folder.make("log")
            if self._publish({f"id={quote(batch_id, safe='')}": sums}, f"log/{state.last + 1:012d}"):
                return True
            state = self._state()  # another batch took the number
            if self._committed(state, batch_id):
                return False

    def compact(self, grace_ms: int = GRACE_MS) -> bool:
        """Sums the log into one folder, which totals and commits then read in its place; False if there is nothing new.

        What an earlier compaction replaced is deleted once it is older than the grace.
        """
        state = self._state()
        if state.last == state.upto:
            return False
        fresh = [(batch,) for n, batch in state.log if n > state.upto]
        names = self._names(state).union(self.spark.createDataFrame(fresh, "name string"))
        self.folder.make("upto")
        if not self._publish({"sums": self._total(self._sums(state)), "names": names}, f"upto/{state.last:012d}"):
            return False
        entries = [(int(name), f"{kind}/{name}", changed) for kind in ("log", "upto") for name, changed in self.folder.entries(kind)]
        now = max(changed for _, _, changed in entries)  # by the clock of the store
        for n, name, changed in entries:
            if (n <= state.upto if name.startswith("log") else n < state.upto) and now - changed >= grace_ms:
                self.folder.delete(name)
        return True

    def _total(self, sums: DataFrame) -> DataFrame:
        totals = sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return totals.filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens over all committed batches."""
        return self._total(self._sums(self._state()))


def new_rollup(spark: SparkSession) -> Rollup:
    return Rollup(spark, new_path(spark, "rollup"))
