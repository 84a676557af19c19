"""Courses as Spark data sources: words or outlines of PDF files by a parser that the user names, and documents written as files.

A parser is `module:name` of a callable that takes an open file and gives a document with `pages` (how many), `words(page)` (an iterator of
text, x0, x1, top, bottom, doctop, size, fontname, page_h) and `outline()` (an iterator of level, title, page_idx). No library is behind it here.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tessella.operators.errors import message
from tessella.sources.answers import file_system

WORDS = "doc_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, fontname string, page_h double, error string"
OUTLINE = "doc_id string, ord int, level int, title string, page_idx int, error string"
DOCUMENTS = "name string, json string"


def parser_of(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def pdf_files(path: str) -> list[tuple[str, str]]:
    """(doc_id, path) of the PDF files of a folder, sorted by name, or of the one file; an error if there is no such path."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{path} doesn't exist")
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at))
    named = [f for f in found if f.is_file and f.base_name.lower().endswith(".pdf")]
    return sorted((f.base_name[:-4], f.path) for f in named)


@dataclass
class PageRange(InputPartition):
    """Pages first to last (None: to the end) of one file."""

    doc_id: str
    path: str
    first: int = 0
    last: int | None = None


@dataclass
class CourseReader(DataSourceReader):
    """A partition for each file, or for `pages_per_task` pages of it. Filters on doc_id leave out files, those on page_idx leave out pages: neither is opened or read."""

    path: str
    parser: str
    kind: str
    pages_per_task: int = 0
    docs: set[str] | None = None
    first: int = 0
    last: int | None = None
    pages: dict[str, int] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("doc_id",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.docs = named if self.docs is None else self.docs & named
            elif column == ("page_idx",) and self.kind == "words" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else 0
                high = f.value - isinstance(f, LessThan) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else None
                self.first = max(self.first, low)
                self.last = high if self.last is None else self.last if high is None else min(self.last, high)
            yield f  # error rows have no page, so Spark looks again

    def partitions(self) -> Sequence[InputPartition]:
        files = [(doc, path) for doc, path in pdf_files(self.path) if self.docs is None or doc in self.docs]
        step = self.pages_per_task
        if self.kind != "words" or not step or self.last is None:
            return [PageRange(doc, path, self.first, self.last) for doc, path in files]
        return [PageRange(doc, path, a, min(a + step - 1, self.last)) for doc, path in files for a in range(self.first, self.last + 1, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition is None:  # Spark's word for no partition at all
            return
        width = len((WORDS if self.kind == "words" else OUTLINE).split(", "))
        try:
            fs, at = file_system(partition.path)
            with fs.open_input_file(at) as f:
                document = parser_of(self.parser)(f)
                if self.kind == "words":
                    last = document.pages - 1 if partition.last is None else min(partition.last, document.pages - 1)
                    for page in range(partition.first, last + 1):
                        for n, word in enumerate(document.words(page)):
                            yield (partition.doc_id, page, n, *word, None)
                else:
                    for n, entry in enumerate(document.outline()):
                        yield (partition.doc_id, n, *entry, None)
        except Exception as e:  # one course's failure is not another's: its row says why
            yield (partition.doc_id, *(None,) * (width - 2), message(e))


class CourseWords(DataSource):
    """spark.read.format("course_words").option("parser", …).load(path): WORDS of all PDF files there; a file that can't be read gives a row with `error`.

    With `pages_per_task`, a range of pages asked for is read by several tasks; a file whose length isn't known is one task's.
    """

    kind = "words"

    @classmethod
    def name(cls) -> str:
        return f"course_{cls.kind}"

    def schema(self) -> str:
        return WORDS if self.kind == "words" else OUTLINE

    def reader(self, schema) -> DataSourceReader:
        return CourseReader(self.options["path"], self.options["parser"], self.kind, int(self.options.get("pages_per_task", 0)))


class CourseOutline(CourseWords):
    """OUTLINE of all PDF files."""

    kind = "outline"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceWriter):
    """Documents as files of their own, in two phases: tasks write aside, commit renames, abort takes all away."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        fs, at = file_system(self.path)
        fs.create_dir(f"{at}/_aside-{self.job}", recursive=True)  # here alone: a task that outlives abort finds no folder and writes nothing

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, at = file_system(self.path)
        own, names = f"{at}/_aside-{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=False)
        for row in iterator:
            with fs.open_output_stream(f"{own}/{row.name}") as f:
                f.write(indented(row.json).encode())
            names.append(f"{os.path.basename(own)}/{row.name}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        placed = [(f"{at}/_aside-{self.job}/{name}", f"{at}/{name.split('/', 1)[1]}") for m in messages if m is not None for name in m.names]
        if not self.overwrite:
            taken = [to for _, to in placed if fs.get_file_info(to).type != pafs.FileType.NotFound]
            if taken:
                self.abort(messages)
                raise FileExistsError(f"{taken[0]} is there already")
        for aside, to in placed:
            fs.move(aside, to)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}/_aside-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_aside-{self.job}")


def indented(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


class CourseFiles(DataSource):
    """df.write.format("course_files").mode("overwrite").save(path): rows of name, json, each as a file of JSON with an indent of two."""

    @classmethod
    def name(cls) -> str:
        return "course_files"

    def schema(self) -> str:
        return DOCUMENTS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CourseWords, CourseOutline, CourseFiles):
        spark.dataSource.register(source)
