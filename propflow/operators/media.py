"""An optional adapter to FFmpeg: one bounded process for each row of a plan.

Nothing else in the library needs it.  Where the tools are absent, rows come
back with ``problem`` = ``no_tool``.
"""

from __future__ import annotations

import os
import selectors
import shutil
import signal
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = ("ffmpeg", "ffprobe")
MOST_OUTPUT, MOST_ERRORS = 8 << 20, 1 << 20


def tools() -> dict[str, str | None]:
    return {t: shutil.which(t) for t in TOOLS}


def preflight(spark: SparkSession, mode: str = "full_production") -> DataFrame:
    """One row a tool: where it is, and whether the mode can do without it."""
    rows = [(mode, t, p, p is not None or mode != "full_production") for t, p in tools().items()]
    return spark.createDataFrame(rows, "mode string, tool string, path string, ready boolean")


def bounded(arguments: list[str], seconds: float) -> tuple[int | None, bytes, str | None]:
    """Exit code, output, and problem of a process in a group of its own with a bare environment; one that runs or prints too long is killed."""
    if shutil.which(arguments[0]) is None:
        return None, b"", "no_tool"
    keep = {k: v for k, v in os.environ.items() if k in ("PATH", "HOME", "LANG", "TMPDIR")}
    process = subprocess.Popen(arguments, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env=keep, start_new_session=True)
    until, kept, problem = time.monotonic() + seconds, bytearray(), None
    room = {process.stdout: MOST_OUTPUT, process.stderr: MOST_ERRORS}
    with selectors.DefaultSelector() as ready, process:
        for pipe in room:
            ready.register(pipe, selectors.EVENT_READ)
        while ready.get_map() and problem is None:
            events = ready.select(max(0.0, until - time.monotonic()))
            if not events:
                problem = "timeout"
            for event, _ in events:
                data = os.read(event.fd, 1 << 16)
                room[event.fileobj] -= len(data)
                if not data:
                    ready.unregister(event.fileobj)
                elif room[event.fileobj] < 0:
                    problem = "too_much_output"
                elif event.fileobj is process.stdout:
                    kept += data
        if problem is None:
            try:
                process.wait(max(0.0, until - time.monotonic()))
            except subprocess.TimeoutExpired:
                problem = "timeout"
        if problem:
            os.killpg(process.pid, signal.SIGKILL)
            return None, b"", problem
    return process.returncode, bytes(kept), None if process.returncode == 0 else "failed"


def run_plan(plan: DataFrame, seconds: float = 120) -> DataFrame:
    """Run ``arguments`` (array) of each row; adds exit_code, output and problem."""
    from pyspark.sql import types as T

    schema = T.StructType([*plan.schema.fields, T.StructField("exit_code", T.IntegerType()), T.StructField("output", T.BinaryType()), T.StructField("problem", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [bounded(list(a), seconds) for a in frame["arguments"]]
            yield frame.assign(exit_code=pd.array([d[0] for d in done], "Int32"), output=[d[1] for d in done], problem=[d[2] for d in done])

    return plan.mapInPandas(run, schema)


def _arguments(*parts) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def decode_check(source: Column) -> Column:
    """Arguments that decode the first frame and keep nothing."""
    return _arguments("ffmpeg", "-v", "error", "-xerror", "-i", source, "-frames:v", "1", "-f", "null", "-")


def thumbnail(source: Column, target: Column, width: int = 320, height: int = 240) -> Column:
    """Arguments for an image fitted into a box and padded."""
    fit = f"scale={width}:{height}:force_original_aspect_ratio=decrease,pad={width}:{height}:(ow-iw)/2:(oh-ih)/2:color=white"
    return _arguments("ffmpeg", "-n", "-v", "error", "-i", source, "-frames:v", "1", "-vf", fit, target)


def upload_derivative(source: Column, target: Column, most: int = 2048) -> Column:
    """Arguments for a copy without metadata, not wider than ``most``."""
    return _arguments("ffmpeg", "-n", "-v", "error", "-i", source, "-map_metadata", "-1", "-frames:v", "1", "-vf", f"scale='min({most},iw)':-2", "-q:v", "2", target)


def sample_frames(clips: DataFrame, source: str, duration: str, folder: str) -> DataFrame:
    """One row a sample frame of each clip, with its arguments."""
    from propflow.functions.text import sample_times

    rows = clips.withColumn("times", sample_times(F.col(duration))).select("*", F.posexplode("times").alias("nth", "seconds")).drop("times")
    target = F.format_string("%s/sample-%d.jpg", F.col(folder), F.col("nth"))
    return rows.withColumn("arguments", _arguments("ffmpeg", "-n", "-v", "error", "-ss", F.format_string("%.3f", "seconds"), "-i", F.col(source), "-frames:v", "1", target))


def normalise(source: Column, target: Column, picture: Column, fps: int = 30) -> Column:
    """Arguments for a silent clip of the output profile; ``picture`` is its filter."""
    return _arguments("ffmpeg", "-n", "-v", "error", "-i", source, "-an", "-vf", picture, "-r", str(fps), "-c:v", "libx264", "-pix_fmt", "yuv420p", target)


def concatenate(listing: Column, target: Column) -> Column:
    """Arguments that join clips of one profile by a list, without encoding them again."""
    return _arguments("ffmpeg", "-n", "-v", "error", "-f", "concat", "-safe", "1", "-i", listing, "-c", "copy", target)
