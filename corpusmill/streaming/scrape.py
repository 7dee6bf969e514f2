"""Scraped metrics as a stream: every trigger asks each target once and keeps what it said until it is processed.

A target answers with text exposition (a line a sample). An offset is the number of the last scrape. What was scraped is
put in a spool folder before its offset is known, so a query that is killed and started again reads the same rows
for the same offsets; committed scrapes are removed. The spool must be shared by driver and executors.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "scraped_at timestamp, target string, metric string, labels map<string,string>, value double"
_SAMPLE = re.compile(r"([A-Za-z_:][\w:]*)\s*(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$")
_LABEL = re.compile(r'\s*([A-Za-z_]\w*)\s*=\s*"((?:[^"\\]|\\.)*)"\s*(?:,|$)')
_ESCAPED = {"n": "\n", "\\": "\\", '"': '"'}


def parsed(line: str) -> tuple[str, dict[str, str], float] | None:
    """metric, labels and value of a line of text exposition; None for comments, blanks and what isn't a sample."""
    line = line.strip()
    found = None if line.startswith("#") else _SAMPLE.match(line)
    if not found:
        return None
    metric, inner, number = found[1], found[2] or "", found[3]
    labels, at = {}, 0
    while at < len(inner):
        one = _LABEL.match(inner, at)
        if not one:
            return None
        labels[one[1]] = re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[0]), one[2])
        at = one.end()
    try:
        return metric, labels, float(number)
    except ValueError:
        return None


class Scrape(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ScrapeReader(DataSourceStreamReader):
    def __init__(self, targets: list[str], spool: str, timeout: float) -> None:
        self.targets, self.spool, self.timeout = targets, spool, timeout

    def _files(self):
        """The spool's file system and folder. Made anew in each process."""
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.spool if "://" in self.spool else f"file://{self.spool}")
        system.create_dir(folder, recursive=True)
        return system, folder

    def _kept(self) -> dict[int, str]:
        from pyarrow import fs

        system, folder = self._files()
        names = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".json")]
        return {int(p.rsplit("/", 1)[1].split(".")[0]): p for p in names}

    def initialOffset(self) -> dict:
        """A new query begins with what its spool holds."""
        return {"scrape": 0}

    def latestOffset(self) -> dict:
        """Scrapes all targets. One that doesn't answer has no samples in this scrape."""
        system, folder = self._files()
        answers = {}
        for target in self.targets:
            try:
                with urlopen(target, timeout=self.timeout) as reply:
                    answers[target] = reply.read().decode("utf-8", "replace")
            except OSError:
                continue
        number = max([*self._kept(), self._last()], default=0) + 1
        for name, what in ((f"{number:012d}.json", {"at": time.time(), "answers": answers}), ("last", number)):
            with system.open_output_stream(f"{folder}/.{name}") as out:
                out.write(json.dumps(what).encode())
            system.move(f"{folder}/.{name}", f"{folder}/{name}")
        return {"scrape": number}

    def _last(self) -> int:
        system, folder = self._files()
        if system.get_file_info(f"{folder}/last").is_file:
            with system.open_input_stream(f"{folder}/last") as said:
                return int(said.read())
        return 0

    def partitions(self, start: dict, end: dict) -> list[Scrape]:
        return [Scrape(p) for n, p in sorted(self._kept().items()) if start["scrape"] < n <= end["scrape"]]

    def read(self, partition: Scrape) -> Iterator[tuple]:
        from datetime import UTC, datetime

        system, _ = self._files()
        with system.open_input_stream(partition.path) as said:
            scrape = json.loads(said.read())
        at = datetime.fromtimestamp(scrape["at"], UTC)
        for target, answer in scrape["answers"].items():
            for line in answer.split("\n"):
                if sample := parsed(line):
                    yield (at, target, *sample)

    def commit(self, end: dict) -> None:
        system, _ = self._files()
        for n, path in self._kept().items():
            if n <= end["scrape"] - 1:  # the last one names the offset after a restart
                system.delete_file(path)

    def stop(self) -> None:
        pass


class MetricScrape(DataSource):
    """Options: targets (URLs, one a line), spool (a shared folder), timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "metric_scrape"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ScrapeReader:
        return ScrapeReader(self.options["targets"].split("\n"), self.options["spool"], float(self.options.get("timeout", "10")))


def scraped(spark: SparkSession, targets: list[str], spool: str, timeout: float = 10) -> DataFrame:
    """scraped_at, target, metric, labels, value of the targets' samples; a trigger is a scrape (every 30 seconds as a rule)."""
    spark.dataSource.register(MetricScrape)
    return spark.readStream.format("metric_scrape").option("targets", "\n".join(targets)).option("spool", spool).option("timeout", str(timeout)).load()
