"""Writers: one CSV of the long table and a JSON manifest, through Spark's file systems."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from guidewell.model import Result

#: Fixed names of the output's files and values of its format.
SCORES, MANIFEST, FORMAT = "ps-score-exact-fast.csv", "ps-score-exact-fast-manifest.json", "csv_long"
HEADER = b"obs_index,ps_score,perturbation\n"


def _plain(value: Any) -> Any:
    """What JSON does not know: arrays and scalars of numpy as lists and numbers, anything else (paths) as text."""
    made = getattr(value, "tolist", None)
    return made() if made else os.fspath(value) if isinstance(value, os.PathLike) else str(value)


def jsonable(value: Any) -> Any:
    """What a JSON reader would get back of ``value``: keys are text, tuples lists."""
    return json.loads(json.dumps(value, default=_plain))


class _Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark, uri: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self._path(uri)
        self.fs = self.path.getFileSystem(self.conf)
        self.fs.mkdirs(self.path)

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def name(self, child: str) -> str:
        return self.fs.makeQualified(self._path(self.path, child)).toString()

    def write(self, child: str, data: bytes) -> None:
        with_out = self.fs.create(self._path(self.path, child), True)
        try:
            with_out.write(bytearray(data))
        finally:
            with_out.close()

    def join(self, parts: str, child: str, head: bytes) -> None:
        """The part files of a folder end to end, in order of their names, after ``head``; streamed, and renamed when whole."""
        found = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.path, parts)))
        temporary, target = self._path(self.path, f"{parts}.whole"), self._path(self.path, child)
        out = self.fs.create(temporary, True)
        try:
            out.write(bytearray(head))
            for name in found:
                if name.startswith("part-"):
                    part = self.fs.open(self._path(self._path(self.path, parts), name))
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, self.conf, False)
                    finally:
                        part.close()
        finally:
            out.close()
        self.fs.delete(target, True)
        if not self.fs.rename(temporary, target):
            raise OSError(f"{temporary.toString()} could not be renamed")

    def delete(self, child: str) -> None:
        self.fs.delete(self._path(self.path, child), True)


def write_output(result: Result, output_dir: str, dataset_path: str | None = None) -> dict[str, Any]:
    """Write the scores and the manifest under ``output_dir``, a path or URI; returns the manifest.

    Tasks write sorted parts into the folder itself, which executors see as the driver does; one file is the format's
    contract, so the parts are joined by one stream.
    """
    folder = _Folder(result.scores.sparkSession, os.fspath(output_dir))
    parts = f".scores-{uuid.uuid4().hex}"
    try:
        result.output().write.option("header", False).option("emptyValue", "").csv(folder.name(parts))
        folder.join(parts, SCORES, HEADER)
    finally:
        folder.delete(parts)
    scores = folder.name(SCORES)
    manifest = jsonable(result.metadata | {"dataset_path": dataset_path, "score_output_format": FORMAT, "score_count": result.table.count(), "score_output_paths": {"scores": scores.removeprefix("file:")}})
    folder.write(MANIFEST, (json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode())
    return manifest
