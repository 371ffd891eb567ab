"""Pages of posts behind cursors as a stream (O-02 to O-04).

A collector lands every page it fetches as a folder of JSON lines,
``<path>/chain=<chain>/cursor=<cursor>/``; each line is a post with the cursor
of the page after it in ``next_cursor``.  A chain is one search or feed in one
language.  It begins at the cursor ``START`` and ends at a page without a next
cursor.

    spark.dataSource.register(PagedPosts)
    spark.readStream.format("paged_posts").schema(...).option("maxPages", 5).load(path)

A stream's offset is the next cursor of each chain, kept in its checkpoint, so
a restarted stream resumes there.  A batch takes at most ``maxPages`` pages of
each chain (the page budget of a run); a chain stops early at a page that is
empty, is not there yet or cannot be read, and goes on from that page in the
next batch.  Only the cursors are followed on the driver, once a batch; pages are
read by the tasks, a page at a time and up to ``PAGES`` of them a task.  Columns ``chain`` and ``cursor`` can be asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.json
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The cursor of a chain's first page, and the offset of a chain at its end.
START, END = "start", None
#: Pages of a task at most, and tasks that a batch is dealt to before they get several pages.
PAGES, TASKS = 64, 32


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _page(fs: pa.fs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")))


class Pages(InputPartition):
    def __init__(self, pages: list[tuple[str, str]]):
        self.pages = pages


class PagedPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return "chain string, cursor string, uri string, langs array<string>, record struct<text: string>"

    def streamReader(self, schema: StructType) -> "PageReader":
        return PageReader(schema, self.options)


class PageReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.budget = int(options.get("maxPages", 5))
        self.at: dict | None = None
        self.following: dict[tuple[str, str], str | None] = {}    # of the pages walked and not planned yet

    def __getstate__(self) -> dict:
        return self.__dict__ | {"following": {}}     # tasks do not need it

    def _folder(self, chain: str, cursor: str, path: str) -> str:
        return f"{path}/chain={chain}/cursor={cursor}"

    def initialOffset(self) -> dict:
        return {}

    def _walk(self, chain: str, cursor: str | None) -> tuple[list[str], str | None]:
        """The pages of a batch from ``cursor`` on, and the cursor after them."""
        fs, path = _files(self.path)
        pages: list[str] = []
        while cursor is not END and len(pages) < self.budget:
            try:
                files = _page(fs, self._folder(chain, cursor, path))
                if not files:
                    break
                with fs.open_input_stream(files[0]) as f:
                    following = json.loads(_first_line(f)).get("next_cursor")
            except (OSError, ValueError):
                break
            pages.append(cursor)
            self.following[chain, cursor] = following or END
            cursor = following or END
        return pages, cursor

    def latestOffset(self) -> dict:
        fs, path = _files(self.path)
        here = dict(self.at or {})
        found = fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True))
        for f in found:
            if f.base_name.startswith("chain="):
                here.setdefault(f.base_name[6:], START)
        for chain, cursor in here.items():
            here[chain] = self._walk(chain, cursor)[1]
        self.at = here
        return here

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.at is None:       # a restarted stream plans its last batch again
            self.at = dict(end)
        fs, path = _files(self.path)
        pages = []
        for chain, stop in end.items():
            cursor = start.get(chain, START)
            while cursor != stop and cursor is not END:
                pages.append((chain, cursor))
                if (chain, cursor) in self.following:
                    cursor = self.following.pop((chain, cursor))
                else:
                    with fs.open_input_stream(_page(fs, self._folder(chain, cursor, path))[0]) as f:
                        cursor = json.loads(_first_line(f)).get("next_cursor") or END
        n = max(1, min(PAGES, len(pages) // TASKS))
        return [Pages(pages[k:k + n]) for k in range(0, len(pages), n)]

    def commit(self, end: dict) -> None:
        if self.at is None:
            self.at = dict(end)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        fs, path = _files(self.path)
        want = to_arrow_schema(self.schema)
        inside = pa.schema([f for f in want if f.name not in ("chain", "cursor")])
        how = pa.json.ParseOptions(explicit_schema=inside, unexpected_field_behavior="ignore")
        for chain, cursor in partition.pages:
            given = {"chain": chain, "cursor": cursor}
            for file in _page(fs, self._folder(chain, cursor, path)):
                with fs.open_input_stream(file) as f:
                    rows = pa.json.read_json(f, parse_options=how)
                columns = [pa.chunked_array([pa.array([given[f.name]] * rows.num_rows, pa.string())]) if f.name in given
                           else rows.column(f.name) for f in want]
                yield from pa.table(columns, schema=want).to_batches()


def _first_line(stream) -> bytes:
    held = b""
    while b"\n" not in held:
        part = stream.read(1 << 16)
        if not part:
            break
        held += part
    return held.split(b"\n", 1)[0]
