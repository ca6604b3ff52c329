"""Picture sizes from the headers of files, whose pixels are never read."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: The markers of frames, C0 to CF without tables, extensions and arithmetic conditioning; markers without a length.
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = {0x01, *range(0xD0, 0xD8)}
_SCAN, _END = 0xDA, 0xD9


def frame_size(stream: BinaryIO) -> tuple[int, int] | None:
    """(width, height) of a JPEG, or None if it has no sound frame before its pixels.

    Walks from marker to marker and seeks over what lies between, so a handful of bytes is read
    whatever comes before the frame.
    """
    if stream.read(2) != b"\xff\xd8":
        return None
    while (byte := stream.read(1)) == b"\xff":
        while byte == b"\xff":  # markers may be filled up
            byte = stream.read(1)
        if not byte or byte[0] in (_SCAN, _END):
            return None
        if byte[0] in _BARE:
            continue
        length = stream.read(2)
        if len(length) < 2 or (size := int.from_bytes(length, "big")) < 2:
            return None
        if byte[0] in _FRAMES:
            head = stream.read(5)
            height, width = int.from_bytes(head[1:3], "big"), int.from_bytes(head[3:5], "big")
            return (width, height) if len(head) == 5 and width and height else None
        stream.seek(size - 2, 1)
    return None


def jpeg_sizes(spark: SparkSession, path: str, pattern: str = "*.jp*g") -> DataFrame:
    """path, length, width and height of the pictures of a folder; sizes are null for files without a sound header, and files without a byte are no rows.

    Spark lists the files; tasks open them and read their headers only.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                system, local = pafs.FileSystem.from_uri(name)
                with system.open_input_file(local) as stream:
                    sizes.append(frame_size(stream) or (None, None))
            width, height = zip(*sizes, strict=True) if sizes else ([], [])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(width, pa.int32()), pa.array(height, pa.int32())], ["path", "length", "width", "height"])

    return listed.mapInArrow(read, "path string, length long, width int, height int")
