"""Archives of publications as a stream: pages of posts, newest first, read on from where the last batch ended."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Posts of an archive page, a fixed value.
PAGE = 12
POST = "publication string, slug string, post_date string, title string, audience string, body_html string"
FIELDS = [f.split()[0] for f in POST.split(", ")][1:]


class FolderPages:
    """Pages from JSON lines below path/publication=<name>/, newest first; path is a URI of a file system that pyarrow
    opens, and every task must reach it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else self.path.replace("file:/", "file:///", 1))

    def publications(self) -> list[str]:
        from pyarrow import fs

        files, root = self._fs()
        there = files.get_file_info(fs.FileSelector(root))
        return sorted(x.base_name.split("=", 1)[1] for x in there if x.type == fs.FileType.Directory and "=" in x.base_name)

    def walk(self, publication: str, at: int) -> Iterator[list[tuple[dict, int]]]:
        """Pages of posts, each with its place, from the place on. A place is the byte in the archive's files, one after the
        other, where a line begins; one that lies within a line, as posts were put in front, stands for the next line."""
        from pyarrow import fs

        files, root = self._fs()
        found = files.get_file_info(fs.FileSelector(f"{root}/publication={publication}"))
        begin, out = 0, []
        for x in sorted((x for x in found if x.base_name.endswith(".json")), key=lambda x: x.path):
            if begin + x.size > at:
                with io.BufferedReader(files.open_input_file(x.path), 1 << 16) as f:
                    place = begin
                    if at > begin:
                        f.seek(at - begin - 1)  # the line break before a line that begins there
                        place = at - 1 + len(f.readline())
                    for line in f:
                        if line.strip():
                            out.append((json.loads(line), place))
                        if len(out) == PAGE:
                            yield out
                            out = []
                        place += len(line)
            begin += x.size
        if out:
            yield out


def _key(post: dict) -> str:
    """Posts in the order of an archive: date, then slug."""
    return f"{post.get('post_date') or ''}|{post.get('slug') or ''}"


class Part(InputPartition):
    def __init__(self, publication: str, start: dict, end: dict) -> None:
        super().__init__((publication, start, end))


class ArchiveReader(DataSourceStreamReader):
    """Offsets: per publication, as strings, the watermark below which all is read (`since`), the newest post of the walk
    that is going on (`top`), the last post that it has read (`last`), and its place in the archive (`next`).

    A walk begins at the newest post and goes back page by page to the watermark. A batch reads at most `cap` posts of a
    publication; what the walk has left is read by the next batches, from its place on. When it has reached the
    watermark, its newest post becomes the watermark, and posts that came meanwhile are the next walk's. Posts are told
    apart by date and slug, so a page that has shifted since gives no post twice.
    """

    def __init__(self, pages, since: str, cap: int) -> None:
        self.pages, self.since, self.cap, self.at = pages, since, cap, None

    def initialOffset(self) -> dict:
        return {"-": {"since": f"{self.since}|~"}}

    def _state(self, offset: dict, publication: str) -> dict:
        return offset.get(publication) or {"since": offset["-"]["since"], "top": "", "last": "", "next": "0"}

    def _walk(self, publication: str, state: dict) -> Iterator[tuple[dict, int]]:
        """The posts that the walk has left, each with its place, newest first."""
        for page in self.pages.walk(publication, int(state["next"])):
            for post, at in page:
                if _key(post) <= state["since"]:
                    return
                if not state["last"] or _key(post) < state["last"]:
                    yield post, at

    def _after(self, publication: str, state: dict) -> dict:
        """Where a batch from the state on ends."""
        n, top, last, place, more = 0, state["top"], state["last"], int(state["next"]), False
        for post, at in self._walk(publication, state):
            if n == self.cap:
                more = True
                break
            n, top, last, place = n + 1, top or _key(post), _key(post), at
        if more:
            return {"since": state["since"], "top": top, "last": last, "next": str(place)}
        return {"since": max(state["since"], top), "top": "", "last": "", "next": "0"}

    def latestOffset(self) -> dict:
        now = self.at or self.initialOffset()
        self.at = {"-": now["-"]} | {p: self._after(p, self._state(now, p)) for p in self.pages.publications()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if self.at is None:  # a restart plans the last batch again
            self.at = end
        names = [p for p in end if p != "-" and self._state(start, p) != end[p]]
        return [Part(p, self._state(start, p), end[p]) for p in names]

    def read(self, partition: Part) -> Iterator[tuple]:
        publication, start, end = partition.value
        done = not end["last"]  # the walk ended in this batch: all that it had left, down to its watermark
        for post, _ in self._walk(publication, start):
            newest = start["top"] or end["top"] or end["since"]
            if _key(post) > newest:
                continue  # came after the batch was planned
            if not done and _key(post) < end["last"]:
                return
            yield (publication, *[post.get(f) for f in FIELDS])

    def commit(self, end: dict) -> None:
        pass


class ArchiveSource(DataSource):
    """spark.readStream.format("archive"): options path, since (ISO time), cap (posts of a publication and batch)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return POST

    def pages(self) -> FolderPages:
        return FolderPages(self.options["path"])

    def streamReader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.pages(), self.options.get("since", ""), int(self.options.get("cap", "50")))


def archive_stream(spark: SparkSession, path: str, since: str = "", cap: int = 50, source: type[ArchiveSource] = ArchiveSource) -> DataFrame:
    """Posts of all publications newer than `since`, at most `cap` of each a batch."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("path", path).option("since", since).option("cap", cap).load()


def drain_polls(spark: SparkSession, stream: Callable[[], DataFrame], out: str, checkpoint: str, most: int = 10_000) -> int:
    """Polls, one batch each, until a poll brings no batch; rows go to out/batch=<n>, which a batch that runs again
    replaces. Returns the number of batches that were committed by now. One query does up to `most` polls, as starting one
    takes longer than a batch."""
    done = []

    def batch(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={k}")
        done.append(k)
        if len(done) > most:
            raise RuntimeError(f"no end after {most} polls")

    q = stream().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return max(done, default=-1) + 1
