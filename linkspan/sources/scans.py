"""A scan over pages that are named by tokens, as a streaming source: its offset is the token of the next page.

Which page comes next is only known from the page before, so the driver follows the tokens, at most ``pages_per_batch`` of them
at a time, and tells each page's attempt that succeeded; the pages themselves are read where their partitions are scheduled. A page
may be asked for ``attempts`` times; a scan ends with its last page, with a page that failed too often, with a token that was there
before, or, where ``max_pages`` is given, with so many pages, and the last row of it says which. The folder ``state`` holds the end of the
planned batch, from which a restart goes on, and a digest of each token up to there, so a loop is noticed across restarts and no offset
grows with the pages before it.

Answers are staged as ``<path>/token=<token>/attempt=<n>/*`` with one JSON document each: ``code`` (200 if not there), ``studies``,
``totalCount``, ``nextPageToken``. An attempt that is not staged is one that was not answered.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows of studies (pos from 0) and one row for each page's answer (pos null): its status and attempts.
SCHEMA = "page int, token string, pos int, status string, attempts int, total long, study string"
FIRST = "first"
#: Fixed value: how often a page is asked for.
ATTEMPTS = 3
#: Bytes of a token's line in the state folder.
_LINE = 17
OK, ERROR, LOOP, TOO_MANY, LAST = "OK", "RETRIEVAL_ERROR", "TOKEN_REPEATED", "PAGE_CAP", "LAST"


class PagedScan(DataSource):
    """``spark.readStream.format("paged_scan").option("path", ...).option("state", ...)``; options pages_per_batch, attempts, max_pages (none unless given: a scan without a loop is followed to its end).

    Both folders are shared ones that Python can open."""

    @classmethod
    def name(cls) -> str:
        return "paged_scan"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return _Scan(o["path"], o["state"], int(o.get("pages_per_batch", 16)), int(o.get("attempts", ATTEMPTS)), int(o["max_pages"]) if "max_pages" in o else None)


def _answer(folder: str, token: str, attempt: int) -> dict | None:
    """What was staged for an attempt, or None where there was no answer that can be read."""
    for path in sorted(glob.glob(f"{glob.escape(folder)}/token={glob.escape(token)}/attempt={attempt}/[!._]*")):
        with open(path, encoding="utf-8") as f:
            try:
                return json.load(f)
            except ValueError:
                return None
    return None


def _digest(token: str) -> str:
    return hashlib.blake2b(token.encode(), digest_size=8).hexdigest()


class _Scan(DataSourceStreamReader):
    def __init__(self, folder: str, state: str, pages: int, attempts: int, most: int | None) -> None:
        self.folder, self.state = (x.removeprefix("file://").removeprefix("file:") for x in (folder, state))
        self.pages, self.attempts, self.most = pages, attempts, most
        self._kept = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kept": None}  # tasks need no tokens

    def initialOffset(self) -> dict:
        return {"page": 0, "token": FIRST, "ended": ""}

    def _seen(self, pages: int) -> set[str]:
        """Digests of the tokens of the first so many pages."""
        if self._kept is None or len(self._kept) != pages:
            self._kept = set()
            if pages:
                with open(f"{self.state}/seen.txt", encoding="ascii") as f:
                    self._kept.update(f.read(pages * _LINE).split())
        return self._kept

    def latestOffset(self) -> dict:
        """The offset after the next pages; it is the same until its batch is planned."""
        planned = f"{self.state}/planned.json"
        at = self.initialOffset()
        if os.path.exists(planned):
            with open(planned, encoding="utf-8") as f:
                at = json.load(f)
        before, new = self._seen(at["page"]), set()
        for _ in range(self.pages):
            if at["ended"]:
                break
            new.add(_digest(at["token"]))
            answered, _, following = self._asked(at["token"])
            number, name = at["page"] + 1, _digest(following)
            if not answered:
                ended = ERROR
            else:
                ended = LAST if not following else LOOP if name in before or name in new else TOO_MANY if self.most is not None and number >= self.most else ""
            at = {"page": number, "token": following, "ended": ended}
        return at

    def _asked(self, token: str) -> tuple[bool, int, str]:
        """Whether a page came, after how many attempts, and the token that it names."""
        for n in range(self.attempts):
            got = _answer(self.folder, token, n)
            if got is not None and got.get("code", 200) == 200:
                return True, n + 1, got.get("nextPageToken") or ""
        return False, self.attempts, ""

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        told, token = [], start["token"]
        for number in range(start["page"], end["page"]):
            answered, tried, following = self._asked(token)
            told.append((number, token, tried, answered, end["ended"] if number + 1 == end["page"] else ""))
            token = following
        # The offset is in the query's log before its batch is planned, so this is never ahead of it. A batch that is planned again writes its tokens again.
        os.makedirs(self.state, exist_ok=True)
        with open(f"{self.state}/seen.txt", "ab") as f:
            f.truncate(start["page"] * _LINE)
            f.write("".join(f"{_digest(t[1])}\n" for t in told).encode())
        with open(f"{self.state}/planned.tmp", "w", encoding="utf-8") as f:
            json.dump(end, f)
        os.replace(f"{self.state}/planned.tmp", f"{self.state}/planned.json")
        if self._kept is not None and len(self._kept) == start["page"]:
            self._kept.update(_digest(t[1]) for t in told)
        return [InputPartition(t) for t in told]

    def read(self, partition: InputPartition):
        number, token, tried, answered, ended = partition.value
        doc = (_answer(self.folder, token, tried - 1) or {}) if answered else {}
        total = doc.get("totalCount")
        yield number, token, None, (ended or OK) if answered else ERROR, tried, total, None
        for pos, study in enumerate(doc.get("studies") or ()):
            yield number, token, pos, OK, tried, total, json.dumps(study)

    def commit(self, end: dict) -> None:
        pass


def staged(pages: DataFrame, path: str) -> None:
    """Writes answers (token, attempt, value: the JSON document) where a scan finds them."""
    pages.select("token", "attempt", "value").repartition("token", "attempt").write.partitionBy("token", "attempt").text(path)


def scanned(spark, path: str, sink: str, checkpoint: str, **options) -> DataFrame:
    """All rows of a scan, by way of a table; called again with the same folders it goes on where it ended."""
    spark.dataSource.register(PagedScan)
    stream = spark.readStream.format("paged_scan").option("path", path).option("state", f"{checkpoint}-scan").options(**options).load()
    stream = stream.coalesce(spark.sparkContext.defaultParallelism)  # a task has many pages, and a batch few files
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(SCHEMA).parquet(sink)


def retrieval(rows: DataFrame, id: str = "study") -> DataFrame:
    """Retrieved (distinct studies), total (as first reported), pages, attempts, ended, status of a scan.

    OK only where every page came and at least as many studies as were reported; NO_TRIALS where there are none; RETRIEVAL_ERROR where a
    page failed too often; else INCOMPLETE_RETRIEVAL, also where no total was reported."""
    page = F.col("pos").isNull()
    out = rows.agg(
        F.count_distinct(F.when(~page, F.col(id))).alias("retrieved"), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("page"))).alias("total"),
        F.count_if(page).alias("pages"), F.coalesce(F.sum(F.when(page, F.col("attempts"))), F.lit(0)).alias("attempts"), F.max_by("status", F.when(page, F.col("page"))).alias("ended"),
    )
    whole = (F.col("ended") == LAST) & F.coalesce(F.col("retrieved") >= F.col("total"), F.lit(False))
    return out.withColumn("status", F.when(F.col("ended") == ERROR, ERROR).when(F.col("retrieved") == 0, "NO_TRIALS").when(whole, OK).otherwise("INCOMPLETE_RETRIEVAL"))
