"""A genome packed into files of bases that are read by range.

Bases are written once, in slabs of neighbouring bins, each followed by the first bases of the next slab, with a table of
where each slab stands. Four bases are a byte; the stretches of other letters follow a slab's bytes. Windows are then cut by tasks
that read the ranges they need: the windows are dealt by place, so each
task goes through its files in order, and no base is scanned, joined or shuffled that no window asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.functions.dna import as_bytes
from lociframe.session import stored
from lociframe.sources.lines import on_store

SLAB_BINS = 512         # bins of a slab
HALO = 1 << 14          # bases of the next slab that a slab repeats
RUNS_A_TASK = 8         # runs, of a slab at most, that a task reads whole
SLABS_A_TASK = 16       # slabs that a task makes and writes
GAP, READ = 1 << 14, 4 << 20      # ranges closer than GAP are read together, up to READ bases
_ATTEMPTS = 1 << 40     # above the number of any task's attempt, so that a file's number tells its part and its attempt

_RUNS = "chrom string, slab long, first long, length long, own long, file string, offset long, others long, number long"
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_NUMBERS = np.full(256, 4, np.uint8)
_NUMBERS[_LETTERS] = np.arange(4)
_FOUR = np.stack([_LETTERS[np.arange(256) >> shift & 3] for shift in (0, 2, 4, 6)], axis=1).copy().view(np.uint32).ravel()


def _file_name(number: int, kind: str = "bases") -> str:
    return f"part-{number // _ATTEMPTS:05d}-{number % _ATTEMPTS}.{kind}"


class _Run:
    """A run as it is written: the bases of a byte that is not full yet, and its stretches of other letters."""

    def __init__(self, sink):
        self.sink, self.rest, self.length, self.others = sink, np.zeros(0, np.uint8), 0, []

    def add(self, data: bytes) -> int:
        letters = np.frombuffer(data, np.uint8)
        codes = _NUMBERS[letters]
        other = np.flatnonzero(codes > 3)
        if len(other):
            begins = np.flatnonzero((np.diff(other, prepend=-2) != 1) | (np.diff(letters[other], prepend=letters[other[0]]) != 0))
            ends = other[np.append(begins[1:], len(other)) - 1] + 1
            self.others.append((other[begins] + self.length, ends + self.length, letters[other[begins]]))
            codes[other] = 0
        self.length += len(codes)
        codes = np.concatenate([self.rest, codes])
        whole = len(codes) // 4 * 4
        self.rest = codes[whole:]
        return self._put(codes[:whole])

    def _put(self, codes: np.ndarray) -> int:
        four = codes.reshape(-1, 4)
        self.sink.write((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes())
        return len(four)

    def end(self) -> tuple[int, int]:
        """How many bytes were written to end the run, and how many of them, the last ones, hold other letters."""
        size = self._put(np.append(self.rest, np.zeros(-len(self.rest) % 4, np.uint8)))
        if not self.others:
            return size, 0
        begins, ends, letters = (np.concatenate(x) for x in zip(*self.others))
        tail = np.array([len(begins)], np.int64).tobytes() + begins.astype(np.int64).tobytes() + ends.astype(np.int64).tobytes() + letters.tobytes()
        self.sink.write(tail)
        return size + len(tail), len(tail)


def _others_of(source, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The stretches of other letters of a run, at a place of its file; none at -1."""
    if at < 0:
        return None
    n = int(np.frombuffer(source.read_at(8, at), np.int64)[0])
    data = source.read_at(17 * n, at + 8)
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n)


def _bases_of(source, offset: int, others, first: int, last: int) -> bytes:
    """The bases from first to last of the run that begins at offset."""
    low = first // 4
    codes = np.frombuffer(source.read_at(-(-last // 4) - low, offset + low), np.uint8)
    letters = _FOUR[codes].view(np.uint8)[first - 4 * low:last - 4 * low]
    if others is not None:
        begins, ends, other = others
        a, z = np.searchsorted(ends, first, "right"), np.searchsorted(begins, last)
        if a < z:
            lo = np.maximum(begins[a:z], first) - first
            n = np.minimum(ends[a:z], last) - first - lo
            letters[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(other[a:z], n)
    return letters.tobytes()


@dataclass(frozen=True)
class PackedGenome:
    """table: (chrom, bin, seq). runs: of bases without a hole, each with the slab it begins in, its first base, its
    length with and without the next slab's bases, its place in a file below path, and that of its other letters."""
    table: DataFrame
    runs: DataFrame
    path: str
    bin_width: int
    slab_bins: int = SLAB_BINS
    halo: int = HALO

    def bins(self, halo: int) -> DataFrame:
        """(chrom, bin, bases): every bin, as binary, followed by the first `halo` bases of what comes next."""
        if halo > self.halo:
            raise ValueError(f"a halo of {halo} is more than the {self.halo} bases that were packed")
        width = self.bin_width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    store, place = on_store(r["file"])
                    with store.open_input_file(place) as source:
                        data = _bases_of(source, r["offset"], _others_of(source, r["others"]), 0, min(r["length"], r["own"] + halo))
                    begins = range(0, r["own"], width)
                    for k in range(0, len(begins), 256):
                        part = begins[k:k + 256]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["chrom"]] * len(part)), pa.array([(r["first"] + b) // width for b in part], pa.int64()),
                             pa.array([data[b:b + width + halo] if b + width <= r["own"] else data[b:] for b in part], pa.binary())],
                            names=["chrom", "bin", "bases"])
        # A number of tasks of its own, as the runs are some small rows, which adaptive execution would put into one task.
        n = self.runs.count()
        tasks = max(1, min(n, max(self.runs.sparkSession.sparkContext.defaultParallelism, -(-n // RUNS_A_TASK))))
        return self.runs.repartition(tasks).mapInArrow(cut, "chrom string, bin long, bases binary")

    def cut(self, df: DataFrame, start: str, end: Column, out: str) -> DataFrame:
        """df with the bases of [start, end) as a column; NULL where some are missing. Ranges have at most `halo` + 1 bases."""
        # Rows of one place, or of none, are spread by what else they hold. They are placed in files once they are dealt, so only df's columns are shuffled.
        plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        dealt = df.repartitionByRange("chrom", start, F.xxhash64(*plain))
        placed = self.placed(dealt, F.col("chrom"), F.col(start), end).sortWithinPartitions("_packed_number", "_packed_offset", "_packed_place")
        kept = [f for f in df.schema.fields if f.name != out]
        schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in kept], T.StructField(out, T.StringType())])
        return placed.mapInArrow(_cutter([f.name for f in kept], out, self.path.rstrip("/")), schema)

    def slab_of(self, place: Column) -> Column:
        return F.when(place >= 0, F.floor(place / (self.slab_bins * self.bin_width)).cast("long"))

    def placed(self, df: DataFrame, chrom: Column, start: Column, end: Column) -> DataFrame:
        """df with where [start, end) stands: the file's number, the run's offset and that of its other letters, the place and the size; NULLs where bases are missing."""
        runs = self.runs.select(*[F.col(c).alias(f"_run_{c}") for c in ("chrom", "slab", "first", "length", "own", "number", "offset", "others")])
        at = df.withColumns({"_run_c": chrom, "_run_s": start, "_run_e": end, "_run_at": self.slab_of(start)})
        found = at.join(runs, (F.col("_run_c") == F.col("_run_chrom")) & (F.col("_run_at") == F.col("_run_slab")) & (F.col("_run_s") >= F.col("_run_first"))
                        & (F.col("_run_s") < F.col("_run_first") + F.col("_run_own")), "left")
        fits = (F.col("_run_e") >= F.col("_run_s")) & (F.col("_run_e") <= F.col("_run_first") + F.col("_run_length"))
        what = {"number": F.col("_run_number"), "offset": F.col("_run_offset"), "others": F.col("_run_others"),
                "place": F.col("_run_s") - F.col("_run_first"), "size": F.col("_run_e") - F.col("_run_s")}
        return found.select(*[f"`{c}`" for c in df.columns], *[F.when(fits, x).cast("long").alias(f"_packed_{c}") for c, x in what.items()])

    def mark(self, intervals: DataFrame, longest: int) -> DataFrame:
        """Disjoint intervals (chrom, start, end) written by slab, as files beside the bases, with the table of where each slab's are: those that a
        range of at most `longest` bases that starts in the slab can touch."""
        path, size = self.path.rstrip("/"), self.slab_bins * self.bin_width
        last = F.expr(f"greatest(start, end - 1) div {size}")
        rows = intervals.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("chrom is not null and start is not null")
        rows = rows.withColumn("slab", F.explode(F.sequence(F.expr(f"greatest(start - {longest}, 0) div {size}"), F.greatest(last, F.lit(0).cast("long")))))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = on_store(path)
            store.create_dir(folder)
            task = TaskContext.get()
            number = task.partitionId() * _ATTEMPTS + task.taskAttemptId()
            name, at, found, key, parts = _file_name(number, "marks"), 0, [], None, []

            def put() -> int:
                data = np.concatenate(parts, axis=1)
                sink.write(np.ascontiguousarray(data).tobytes())
                found.append((*key, number, at, data.shape[1]))
                return at + 16 * data.shape[1]

            with store.open_output_stream(f"{folder}/{name}", compression=None) as sink:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    chroms, slabs = batch.column("chrom").to_pylist(), batch.column("slab").to_numpy()
                    both = np.stack([batch.column(c).to_numpy() for c in ("start", "end")])
                    begins = [0, *[k for k in range(1, len(slabs)) if slabs[k] != slabs[k - 1] or chroms[k] != chroms[k - 1]], len(slabs)]
                    for lo, hi in zip(begins[:-1], begins[1:]):
                        if (chroms[lo], int(slabs[lo])) != key:
                            at, parts = put() if parts else at, []
                            key = chroms[lo], int(slabs[lo])
                        parts.append(both[:, lo:hi])
                if parts:
                    at = put()
            if not found:
                store.delete_file(f"{folder}/{name}")
            kinds = [pa.string(), *[pa.int64()] * 4]
            names = ["chrom", "slab", "number", "offset", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, kinds)], names=names)

        rows = rows.withColumn("end", F.coalesce("end", F.lit(-1 << 63)))      # one without an end touches nothing
        dealt = rows.repartition("chrom", "slab").sortWithinPartitions("chrom", "slab", "start", "end")
        return stored(dealt.mapInArrow(write, "chrom string, slab long, number long, offset long, n long"))

    def first_matches(self, draws: DataFrame, marks: DataFrame, tolerance: float, most_n: float, far: int) -> DataFrame:
        """(_target, _draw): of the draws (_target, chrom, start, end, target_gc, attempt) that touch no marked interval and hold no larger share of N than most_n, the
        least number of each _target; far is added to those that are not within the tolerance of the GC share.

        Draws are dealt by pieces of slabs and judged where the bases and the marks are read; no base and no interval is shuffled.
        """
        piece = max(1, self.slab_bins // 16) * self.bin_width
        dealt = draws.repartition("chrom", F.floor(F.col("start") / piece))
        placed = self.placed(dealt, F.col("chrom"), F.col("start"), F.col("end")).where("_packed_size > 0")
        where = marks.select(F.col("chrom").alias("_m_chrom"), F.col("slab").alias("_m_slab"), F.col("number").alias("_m_number"), F.col("offset").alias("_m_offset"), F.col("n").alias("_m_n"))
        placed = placed.join(where, (F.col("chrom") == F.col("_m_chrom")) & (self.slab_of(F.col("start")) == F.col("_m_slab")), "left")
        placed = placed.select("_target", "attempt", "target_gc", "start", "_m_number", "_m_offset", "_m_n", *[f"_packed_{c}" for c in ("number", "offset", "others", "place", "size")])
        judged = placed.sortWithinPartitions("_packed_number", "_packed_offset", "_packed_place").mapInArrow(
            _judge(self.path.rstrip("/"), tolerance, most_n, far), "_target long, _draw long")
        return judged.groupBy("_target").agg(F.min("_draw").alias("_draw"))


def _judge(path: str, tolerance: float, most_n: float, far: int):
    def read(number: int, at: int, n: int) -> np.ndarray:
        store, place = on_store(f"{path}/{_file_name(number, 'marks')}")
        with store.open_input_file(place) as source:
            return np.frombuffer(source.read_at(16 * n, at), np.int64).reshape(2, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, own, others, marks = None, None, None, None, None
        for batch in batches:
            number, offset, place, size, start, target, ids, attempt = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("_packed_number", "_packed_offset", "_packed_place", "_packed_size", "start", "target_gc", "_target", "attempt"))
            begins = np.append(np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(offset, prepend=-1) != 0)), len(number))
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
                if number[lo] != now or offset[lo] != own:
                    if number[lo] != now:
                        if source is not None:
                            source.close()
                        store, file = on_store(f"{path}/{_file_name(int(number[lo]))}")
                        now, source = number[lo], store.open_input_file(file)
                    own, others = offset[lo], _others_of(source, batch.column("_packed_others")[lo].as_py())
                    file = batch.column("_m_number")[lo].as_py()      # a run lies in one slab
                    marks = None if file is None else read(file, batch.column("_m_offset")[lo].as_py(), batch.column("_m_n")[lo].as_py())
                at = np.arange(lo, hi)
                if marks is not None:
                    before = np.searchsorted(marks[0], start[at] + size[at]) - 1
                    at = at[(before < 0) | (marks[1][before] <= start[at])]
                if not len(at):
                    continue
                first, last = place[at], place[at] + size[at]
                reach = np.maximum.accumulate(last)
                groups = np.append(np.flatnonzero(np.append(True, first[1:] > reach[:-1] + GAP)), len(at))
                for a, z in zip(groups[:-1].tolist(), groups[1:].tolist()):
                    base = int(first[a])
                    letters = np.frombuffer(_bases_of(source, int(own), others, base, int(reach[z - 1])), np.uint8)
                    s, e = first[a:z] - base, last[a:z] - base

                    def share(hit):
                        upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                        return (upto[e] - upto[s]) / (e - s)
                    kept = at[a:z]
                    near = np.abs(share((letters == 71) | (letters == 67)) - target[kept]) <= tolerance
                    ok = np.ones(z - a, bool) if others is None else share(letters == 78) <= most_n
                    yield pa.RecordBatch.from_arrays([pa.array(ids[kept][ok]), pa.array((attempt[kept] + np.where(near, 0, far))[ok].astype(np.int64))], names=["_target", "_draw"])
        if source is not None:
            source.close()
    return run


def _cutter(kept: list[str], out: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, others, own = None, None, None, None
        for batch in batches:
            number, offset, other, place, size = (batch.column(f"_packed_{c}").fill_null(-1).to_numpy(zero_copy_only=False) for c in ("number", "offset", "others", "place", "size"))
            end = place + size
            cut: list[str | None] = [None] * len(number)
            k = int(np.searchsorted(number, 0))         # rows without a place come first
            while k < len(number):
                if number[k] != now:
                    if source is not None:
                        source.close()
                    store, file = on_store(f"{path}/{_file_name(int(number[k]))}")
                    now, source, own = number[k], store.open_input_file(file), None
                if offset[k] != own:
                    own, others = offset[k], _others_of(source, int(other[k]))
                last, j = int(end[k]), k + 1
                while j < len(number) and number[j] == now and offset[j] == own and place[j] <= last + GAP and max(last, end[j]) - place[k] <= READ:
                    last, j = max(last, int(end[j])), j + 1
                first = int(place[k])
                text = _bases_of(source, int(own), others, first, last).decode("ascii")
                for i in range(k, j):
                    cut[i] = text[place[i] - first:end[i] - first]
                k = j
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(cut, pa.string())], names=[*kept, out])
        if source is not None:
            source.close()
    return run


def pack_genome(genome: DataFrame, path: str, bin_width: int, slab_bins: int = SLAB_BINS, halo: int = HALO, bases: Column | None = None) -> PackedGenome:
    """Write a genome table (chrom, bin, seq) as files of bases below path, upper case and two bits each, and return it with the table of its runs.

    A bin that is missing, or shorter than the others before the end of its contig, ends a run. Files are named by the
    attempt that wrote them and the table names those of finished tasks alone, so a task that is run again does no harm.
    bases is an expression of the other columns for a genome that has no seq, such as of a place in some store: bins are dealt
    before they get their bases, so that only those columns are shuffled and sorted.
    """
    table = genome if bases is None else genome.select("chrom", "bin", bases.alias("seq"))
    reach = -(-halo // bin_width)
    if reach > slab_bins:
        raise ValueError(f"a halo of {halo} does not fit slabs of {slab_bins} bins")
    made = as_bytes(F.upper("seq" if bases is None else bases)).alias("bases")
    bins = genome.withColumn("bin", F.col("bin").cast("long")).where("bin >= 0")
    if bases is None:
        bins = bins.select("chrom", "bin", made)
    own = bins.withColumn("slab", F.expr(f"bin div {slab_bins}"))
    heads = own.where((F.col("bin") % slab_bins < reach) & (F.col("slab") > 0)).withColumn("slab", F.col("slab") - 1)
    # Without bases the rows are small, and adaptive execution would put them into one task.
    tasks = [] if bases is None else [max(genome.sparkSession.sparkContext.defaultParallelism, -(-genome.count() // (SLABS_A_TASK * slab_bins)))]
    dealt = own.unionByName(heads).repartitionByRange(*tasks, "chrom", "slab").sortWithinPartitions("chrom", "slab", "bin")
    if bases is not None:
        dealt = dealt.select("chrom", "slab", "bin", made)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = on_store(path)
        store.create_dir(folder)
        task = TaskContext.get()
        number = task.partitionId() * _ATTEMPTS + task.taskAttemptId()
        name = _file_name(number)
        runs: list[list] = []
        at, whole, key, next_bin, room, run = 0, False, None, -1, 0, None

        def ended() -> int:
            if run is None:
                return at
            size, others = run.end()
            runs[-1][7] = at + size - others if others else -1
            return at + size
        with store.open_output_stream(f"{folder}/{name}", compression=None) as sink:
            for batch in batches:
                for chrom, slab, place, bases in zip(*(batch.column(c).to_pylist() for c in ("chrom", "slab", "bin", "bases"))):
                    is_own = place // slab_bins == slab
                    if (chrom, slab) != key or place != next_bin or not whole:
                        if not is_own:          # the next slab's bases after a hole belong to no run of this slab
                            key, next_bin = (chrom, slab), -1
                            continue
                        at = ended()
                        runs.append([chrom, slab, place * bin_width, 0, 0, f"{path.rstrip('/')}/{name}", at, -1, number])
                        run, room = _Run(sink), halo
                    data = bases if is_own else bases[:room]
                    room -= 0 if is_own else len(data)
                    at += run.add(data)
                    runs[-1][3] += len(data)
                    runs[-1][4] += len(data) if is_own else 0
                    key, next_bin, whole = (chrom, slab), place + 1, len(bases) == bin_width
            ended()
        if not runs:
            store.delete_file(f"{folder}/{name}")
        names = [x.split()[0] for x in _RUNS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for k in range(0, len(runs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs[k:k + 10_000]), kinds)], names=names)

    return PackedGenome(table, stored(dealt.mapInArrow(write, _RUNS)), path, bin_width, slab_bins, halo)


def bytes_asked(genome: PackedGenome, df: DataFrame, start: str, end: Column) -> int:
    """How many bases a cut reads at most: those of its windows and the gaps that are read over."""
    spans = df.select((F.col("chrom")), F.col(start).alias("s"), end.alias("e")).distinct()
    return spans.agg(F.sum(F.col("e") - F.col("s") + GAP)).first()[0] or 0
