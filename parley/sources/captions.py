"""Caption lines as a stream: NDJSON files that grow, one folder per meeting and track.

    root/meeting_id=<meeting>/track=<track>/<any name>

A line is an event with t (partial, final or done), start, end and text, and if the recorder stamps
them at (milliseconds) and n (its number). What a batch takes is named by the bytes read of each
file, so a batch that is repeated reads the same bytes. Only whole lines are taken; one that is still
being written waits for its end. A file is read in ranges by several tasks; a line belongs to the
range it begins in.

A line that is no event is a row with t = 'bad' and the line as text, so it can be counted; `events`
leaves it out. When a track has ended (a file `_END` lies in its folder, or the option `ended` says
so for all) it gives one event `done`, as a byte more than the file has.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parley.sources.store import _place

FORMAT = "caption_files"
RANGE = 32 << 20
TAIL = 1 << 16
FILE_COST = 1 << 16  # opening a file costs as much as reading these bytes
END = "_END"
SCHEMA = ("meeting_id string, track string, t string, start double, end double, text string, arrival_ms long, "
          "event_id long, arrival timestamp")
KINDS = ("partial", "final", "done")


class Range(InputPartition):
    """Bytes [start, end) of a file that has `size` whole bytes; `done` for the event after them."""

    def __init__(self, name, start, end, done):
        self.name, self.start, self.end, self.done = name, start, end, done


class Ranges(InputPartition):
    """What one task reads: a range of a long file, or many short files."""

    def __init__(self, ranges):
        self.ranges = ranges


def _keys(name):
    parts = dict(p.split("=", 1) for p in name.split("/") if "=" in p)
    return parts.get("meeting_id"), parts.get("track")


def _number(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


class CaptionReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.ended = options["path"], options.get("ended", "false") == "true"
        self.range = int(options.get("range", RANGE))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        """Whole lines of every file there is, and one more where the track has ended."""
        from pyarrow import fs
        system, root = _place(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file]
        over = {i.path.rsplit("/", 1)[0] for i in found if i.base_name == END}
        out = {}
        for i in found:
            if i.base_name[0] in "_." or not all(_keys(i.path[len(root):])):
                continue
            ended = self.ended or i.path.rsplit("/", 1)[0] in over
            out[i.path[len(root):].lstrip("/")] = i.size + 1 if ended else self._whole(system, i)
        return out

    def _whole(self, system, info):
        """Bytes up to the last line end."""
        end = info.size
        with system.open_input_file(info.path) as f:
            while end > 0:
                start = max(0, end - TAIL)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start, end):
        """Ranges of files, together as long as one range; a file counts at least FILE_COST."""
        out, cost = [], self.range
        for name, stop in sorted(end.items()):
            at = start.get(name, 0)
            while at < stop:
                to = min(at + self.range, stop)
                cost += max(to - at, FILE_COST)
                if cost > self.range:
                    out.append([])
                    cost = max(to - at, FILE_COST)
                out[-1].append(Range(name, at, to, at > 0))
                at = to
        return [Ranges(ranges) for ranges in out]

    def read(self, partition):
        for one in partition.ranges:
            yield from self._range(one)

    def _range(self, partition):
        import datetime
        system, root = _place(self.path)
        meeting, track = _keys(partition.name)
        now = datetime.datetime.now(datetime.timezone.utc)
        info = system.get_file_info(f"{root}/{partition.name}")
        with system.open_input_file(f"{root}/{partition.name}") as f:
            at = partition.start
            if at:  # the line that the byte before belongs to is the range's before
                f.seek(at - 1)
                at += len(_line(f, info.size - at + 1)) - 1
            f.seek(at)
            while at < min(partition.end, info.size):
                line = _line(f, info.size - at)
                yield from self._event(line, meeting, track, now, at)
                at += len(line)
        if partition.end > info.size:
            yield (meeting, track, "done", None, None, None, int(now.timestamp() * 1000), info.size, now)

    def _event(self, line, meeting, track, now, at):
        import datetime
        text = line.decode("utf-8", "replace").strip()
        if not text:
            return
        try:
            event = json.loads(text)
            kind = event["t"]
            if kind not in KINDS:
                raise ValueError(kind)
        except (ValueError, TypeError, KeyError):
            yield (meeting, track, "bad", None, None, text, int(now.timestamp() * 1000), at, now)
            return
        stamp, number, said = event.get("at"), event.get("n"), event.get("text")
        ms = stamp if isinstance(stamp, int) else int(now.timestamp() * 1000)
        arrival = datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
        yield (meeting, track, kind, _number(event.get("start")), _number(event.get("end")),
               None if said is None else str(said), ms, number if isinstance(number, int) else at, arrival)

    def commit(self, end):
        pass


def _line(f, left):
    """The bytes up to and with the next line end, or all that are left."""
    out = b""
    while left > 0:
        got = f.read(min(TAIL, left))
        if not got:
            break
        at = got.find(b"\n")
        if at >= 0:
            f.seek(f.tell() - len(got) + at + 1)
            return out + got[:at + 1]
        out, left = out + got, left - len(got)
    return out


class CaptionFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return CaptionReader(self.options)


def caption_stream(spark: SparkSession, root: str, ended: bool = False, bytes_per_task: int = RANGE) -> DataFrame:
    """All lines below `root` as a stream, bad ones included."""
    spark.dataSource.register(CaptionFiles)
    return spark.readStream.format(FORMAT).options(
        path=root, ended=str(ended).lower(), range=str(bytes_per_task)).load()


def events(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("t") != "bad")
