"""A log of CSV files that is appended to exactly once (SRC-9).

Each task writes one file, header first, into the batch's own folder below ``_staging``, which readers pass over. When
all are done the driver gets a name from each task, deletes what tasks that failed or ran twice left behind, and puts the
folder in place by one rename. A batch that is there already is not appended again, so a caller who
does not know whether it was (a restarted stream, say) repeats it under the same name. The file system must
rename a folder in one step, as HDFS and local disks do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, none if it had no rows."""

    name: str | None


class LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch, self.run = path, batch, uuid.uuid4().hex

    def folders(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the folder that tasks write to, and the batch's place."""
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path))
        return system, f"{inner}/_staging/{self.run}", f"{inner}/batch-{self.batch}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, staging, _ = self.folders()
        out, name = None, f"{uuid.uuid4().hex}.csv"
        try:
            for rows in iterator:
                if out is None and rows.num_rows:
                    system.create_dir(staging, recursive=True)
                    file = system.open_output_stream(f"{staging}/{name}")
                    out = csv.CSVWriter(file, rows.schema, write_options=csv.WriteOptions(quoting_style="all_valid"))
                if rows.num_rows:
                    out.write_batch(rows)
        finally:
            if out is not None:
                out.close()
                file.close()
        return Written(None if out is None else name)

    def commit(self, messages: list[Written | None]) -> None:
        system, staging, place = self.folders()
        kept = {m.name for m in messages if m is not None and m.name}
        if not kept or system.get_file_info(place).type != fs.FileType.NotFound:
            return self.abort(messages)
        for found in system.get_file_info(fs.FileSelector(staging)):
            if found.base_name not in kept:
                system.delete_file(found.path)
        system.move(staging, place)

    def abort(self, messages: list[Written | None]) -> None:
        system, staging, _ = self.folders()
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class LogSource(DataSource):
    """Format ``csv_log`` with the options path and batch (letters, digits, _ and -; a new one if not given)."""

    @classmethod
    def name(cls) -> str:
        return "csv_log"

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        batch = self.options.get("batch") or uuid.uuid4().hex
        if overwrite or not re.fullmatch(r"[\w-]+", batch, re.A):
            raise ValueError("a log is appended to, by batches named in letters, digits, _ and -")
        return LogWriter(self.options["path"].rstrip("/"), batch)
