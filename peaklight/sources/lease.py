"""A lease on a place in the shared file system: one owner at a time, taken over when its owner no longer shows life."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import SparkSession

from peaklight.sources.writers import _fs, read_json


class LeaseLost(RuntimeError):
    """Another owner has taken the lease over."""


class Lease:
    """A file that says who holds a place and how often it has said so.

    Making the file succeeds for one driver alone.  The owner rewrites it, with a count of beats, every third of ``age`` seconds.
    One that waits watches the file by its own clock: where owner and beats stay the same for ``age`` seconds the owner is gone, and the file is renamed, which again
    succeeds for one alone.  An owner must ask ``check`` before it publishes: it raises LeaseLost where the lease is no longer its own.
    """

    def __init__(self, spark: SparkSession, path: str, age: float = 60.0, wait: float = 3600.0):
        self.spark, self.path, self.age, self.wait = spark, path, age, wait
        self.owner, self.beats = uuid.uuid4().hex, 0
        self._stop, self._thread = threading.Event(), None

    def _read(self, path: str | None = None) -> dict | None:
        """What the file says; None without one, {} where it can't be read: a file that is just being replaced is looked at again."""
        for _ in range(10):
            try:
                return read_json(self.spark, path or self.path)
            except json.JSONDecodeError:
                pass
            except Exception as e:  # py4j wraps what the file system throws
                if "FileNotFound" in str(e):
                    return None
                if "ChecksumException" not in str(e):
                    raise
            time.sleep(0.02)
        return {}

    def _make(self) -> bool:
        """Make the file, where there is none.  The local file system looks before it creates, which two could do at once; Java's own call doesn't."""
        fs, at = _fs(self.spark, self.path)
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                fs.mkdirs(at.getParent())
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(at.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                fs.create(at, False).close()
        except Exception as e:  # py4j wraps what the file system throws
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        self._say()
        return True

    def _say(self) -> None:
        """Write owner and beats over the file, which is never away meanwhile, as a file moved over it could be."""
        fs, at = _fs(self.spark, self.path)
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"owner": self.owner, "beats": self.beats}).encode()))
        out.close()

    def _retire(self, seen: dict) -> None:
        """Rename the file of an owner that is gone; one that beat meanwhile gets it back, for whoever holds it."""
        fs, at = _fs(self.spark, self.path)
        aside = f"{self.path}.{uuid.uuid4().hex}.gone"
        if not fs.rename(at, _fs(self.spark, aside)[1]):
            return
        if (read := self._read(aside)) != seen and read:
            fs.rename(_fs(self.spark, aside)[1], at)
        else:
            fs.delete(_fs(self.spark, aside)[1], False)

    def acquire(self) -> Lease:
        """Wait for the lease; a TimeoutError after ``wait`` seconds."""
        end, last, since = time.monotonic() + self.wait, None, time.monotonic()
        while not self._make():
            now, seen = time.monotonic(), self._read()
            if seen != last:
                last, since = seen, now
            elif seen is not None and now - since >= self.age:
                self._retire(seen)
                continue
            if now >= end:
                raise TimeoutError(f"{self.path} is held by {seen}")
            time.sleep(min(0.2, self.age / 10))
        self._stop.clear()
        self._thread = threading.Thread(target=self._beat, daemon=True)
        self._thread.start()
        return self

    def _beat(self) -> None:
        while not self._stop.wait(self.age / 3):
            try:
                if (self._read() or {}).get("owner") != self.owner:
                    return
                self.beats += 1
                self._say()
            except Exception:  # the next beat tries again; an owner that can't beat will find out in check()
                continue

    def check(self) -> None:
        if (self._read() or {}).get("owner") != self.owner:
            raise LeaseLost(self.path)

    def release(self) -> None:
        """Give the lease back; nothing happens where another owner has it."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join(self.age)
        if (self._read() or {}).get("owner") == self.owner:
            fs, at = _fs(self.spark, self.path)
            fs.delete(at, False)

    def __enter__(self) -> Lease:
        return self.acquire()

    def __exit__(self, *_) -> None:
        self.release()
