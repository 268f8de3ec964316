"""Folder swaps of a partitioned table, with a journal that a crash cannot tear.

A run stages its new partitions in ``<table>/_swap-<run>/new``, out of readers' sight, and then publishes one
journal, ``INTENT``: a line for each partition with what to do and which files it was prepared from.  Until the
journal is there, nothing has happened and ``recover`` throws the staging away; from then on ``recover`` carries the
run to its end, whatever renames were made before the crash:

1. the old folder is renamed into ``_swap-<run>/old``, out of writers' sight, and listed once more: if it holds other
   files than the journal says, it is put back and the partition is left alone (a conflict);
2. for a removal, the catalog's partition is dropped, if the run names a catalog table;
3. the new folder is renamed into place;
4. with all lines done, the run's folder is renamed to ``_done-<run>`` and deleted.

Every step asks the file system what is left to do, so it can be repeated.  Between 1 and 3 a reader finds the
partition missing, never half of it.  Runs on one table are serialised by the scheduler, as all jobs here are.
"""

from __future__ import annotations

import errno
import hashlib
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

NO_FILES = hashlib.sha256(b"").hexdigest()  # the listing of an empty folder


def fs_of(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folder_listing(fs, folder) -> tuple[int, str]:
    """(files, digest of their names and sizes) of a folder and its subfolders; names with ``_`` or ``.`` are hidden."""
    entries, it = [], fs.listFiles(folder, True)
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if not name.startswith(("_", ".")):
            entries.append(f"{name}:{st.getLen()}")
    return len(entries), hashlib.sha256(",".join(sorted(entries)).encode()).hexdigest()


def listing_of(spark: SparkSession, folder: str) -> str | None:
    """The listing digest of a folder; None if there is no such folder."""
    fs, p = fs_of(spark, folder)
    return folder_listing(fs, p)[1] if fs.exists(p) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small driver-made text to a new file."""
    fs, p = fs_of(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a finished file its final name unless that name is taken: one of several publishers wins, the others get False.

    A hard link on a mounted file system, a rename that must not replace elsewhere; both are one atomic step.
    """
    fs, src = fs_of(spark, source)
    _, dst = fs_of(spark, target)
    src, dst = fs.makeQualified(src), fs.makeQualified(dst)
    if dst.toUri().getScheme() == "file":
        try:
            os.link(src.toUri().getPath(), dst.toUri().getPath())
        except FileExistsError:
            return False
        except OSError as e:  # no hard links on this mount: exclusive creation is as good as the mount's own
            if e.errno not in (errno.EPERM, errno.EOPNOTSUPP, errno.EXDEV, errno.EMLINK):
                raise
            return _create_exclusively(src.toUri().getPath(), dst.toUri().getPath(), fs, src)
        fs.delete(src, False)
        return True
    sc = spark.sparkContext
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), sc._jsc.hadoopConfiguration())
    none = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, dst, none)
    except Exception as e:  # py4j wraps Java's FileAlreadyExistsException
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _create_exclusively(source: str, target: str, fs, src) -> bool:
    with open(source, "rb") as f:
        data = f.read()
    try:
        fd = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL)
    except FileExistsError:
        return False
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    fs.delete(src, False)
    return True


class Swap:
    """One run's swaps on a table; ``step`` is told of every step made (tests stop a run there)."""

    def __init__(self, spark: SparkSession, table_path: str, run: str | None = None, catalog: str | None = None,
                 step: Callable[[str], None] = lambda _: None):
        self.spark, self.table = spark, table_path.rstrip("/")
        self.run = run or uuid.uuid4().hex
        self.catalog, self.step = catalog, step
        self.root = f"{self.table}/_swap-{self.run}"
        self.new = f"{self.root}/new"
        self.conflicts: list[str] = []

    def _at(self, folder: str):
        return fs_of(self.spark, folder)

    def _exists(self, folder: str) -> bool:
        fs, p = self._at(folder)
        return bool(fs.exists(p))

    def _move(self, source: str, target: str) -> None:
        fs, src = self._at(source)
        _, dst = self._at(target)
        fs.mkdirs(dst.getParent())
        if fs.exists(dst):  # a rename would go into that folder
            raise RuntimeError(f"{target} appeared while {source} was to take its place; the run's folder is {self.root}")
        if not fs.rename(src, dst):
            raise RuntimeError(f"rename of {source} to {target} failed")

    def declare(self, lines: Sequence[tuple[str, str, str | None, str | None]]) -> None:
        """Publish the journal: (``put`` or ``remove``, partition folder, listing it was prepared from, folder to undo).

        A ``put`` without a staged folder gets an empty one.  A listing of None says that the partition did not
        exist or held no file.  On a conflict the folder to undo (e.g. what was archived of the partition) goes.
        """
        for what, part, _, _ in lines:
            if what == "put" and not self._exists(f"{self.new}/{part}"):
                fs, p = self._at(f"{self.new}/{part}")
                fs.mkdirs(p)
        text = "".join("\t".join((what, part, listing or "-", undo or "-")) + "\n" for what, part, listing, undo in lines)
        write_text(self.spark, f"{self.root}/_intent", f"catalog\t{self.catalog or '-'}\n{text}")
        if not publish_new(self.spark, f"{self.root}/_intent", f"{self.root}/INTENT"):
            raise RuntimeError(f"{self.root} has a journal already")
        self.step("intent")

    def apply(self) -> list[str]:
        """Carry out the journal; returns the partitions put or removed.  ``conflicts`` names those left alone."""
        head, *lines = read_text(self.spark, f"{self.root}/INTENT").splitlines()
        catalog = head.split("\t")[1]
        self.catalog = None if catalog == "-" else catalog
        done = []
        for line in lines:
            what, part, listing, undo = line.split("\t")
            if (self._put if what == "put" else self._remove)(part, None if listing == "-" else listing):
                done.append(part)
            else:
                self.conflicts.append(part)
                if undo != "-":
                    fs, p = self._at(undo)
                    fs.delete(p, True)
        finished = f"{self.table}/_done-{self.run}"
        self._move(self.root, finished)
        self.step("done")
        fs, p = self._at(finished)
        fs.delete(p, True)
        return done

    def _set_aside(self, part: str, listing: str | None) -> bool:
        """Rename the live folder aside if it still is what the journal was written for; True if it is aside now."""
        live, held = f"{self.table}/{part}", f"{self.root}/old/{part}"
        if self._exists(held):
            return True
        if not self._exists(live):
            return listing is None
        self._move(live, held)
        if listing_of(self.spark, held) == (listing or NO_FILES):
            self.step(f"aside {part}")
            return True
        if self._exists(live):  # a writer has made the folder anew: nothing may be lost, so the old one stays aside
            raise RuntimeError(f"{live} changed while it was swapped; its files are kept in {held}")
        self._move(held, live)
        return False

    def _put(self, part: str, listing: str | None) -> bool:
        staged = f"{self.new}/{part}"
        if not self._exists(staged):
            return True
        if not self._set_aside(part, listing):
            return False
        self._move(staged, f"{self.table}/{part}")
        self.step(f"put {part}")
        return True

    def _remove(self, part: str, listing: str | None) -> bool:
        if not self._exists(f"{self.table}/{part}") and not self._exists(f"{self.root}/old/{part}"):
            return listing is None
        if not self._set_aside(part, listing):
            return False
        if self.catalog and not self._exists(f"{self.table}/{part}"):  # a writer's new folder keeps its partition
            self.spark.sql(f"ALTER TABLE {self.catalog} DROP IF EXISTS PARTITION ({partition_spec(part)}) PURGE")
        self.step(f"removed {part}")
        return True


def partition_spec(part: str) -> str:
    """``timeframe=1h/day=2024-01-02`` as SQL: ``timeframe = '1h', day = '2024-01-02'``."""
    pairs = (x.split("=", 1) for x in part.split("/"))
    return ", ".join(f"`{k}` = '{v}'" for k, v in pairs)


def recover(spark: SparkSession, table_path: str) -> list[str]:
    """Finish or undo what crashed runs left in a table; returns the partitions that were put or removed now.

    A run with a journal is carried to its end; staging without one is deleted; the folder of a finished run is
    deleted.  A folder set aside by an earlier kind of purge (``_purge-*``) goes back to its place.
    """
    fs, root = fs_of(spark, table_path)
    if not fs.exists(root):
        return []
    done = []
    for st in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()):
        name = st.getPath().getName()
        if name.startswith("_swap-"):
            swap = Swap(spark, table_path, name[len("_swap-"):])
            if swap._exists(f"{swap.root}/INTENT"):
                done += swap.apply()
            else:
                fs.delete(st.getPath(), True)
        elif name.startswith("_done-"):
            fs.delete(st.getPath(), True)
        elif name.startswith("_purge-"):
            for held in fs.listStatus(st.getPath()):
                live = root.suffix(f"/{held.getPath().getName()}")
                if fs.exists(live) or not fs.rename(held.getPath(), live):
                    raise RuntimeError(f"{held.getPath()} was set aside by a purge that crashed, and {live} exists")
            fs.delete(st.getPath(), True)
    return done
