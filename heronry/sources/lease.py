"""The right to change an index, held as a file that only one process can make.

Works on any file system that creates files exclusively. The file says who
holds it; one left by a process of this machine that has ended is taken over.
Readers never look at it.
"""

from __future__ import annotations

import json
import os
import secrets
import socket
import time

from pyspark.sql import SparkSession

from heronry.sources import files


def _ended(owner: dict) -> bool:
    """Whether the owner was a process of this machine that is no longer there."""
    if owner.get("host") != socket.gethostname():
        return False
    try:
        os.kill(int(owner["pid"]), 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        return False
    return False


class WriterLease:
    """``with WriterLease(spark, index):`` waits for the right to change ``index``, ``patience`` seconds at most."""

    def __init__(self, spark: SparkSession, index: str, patience: float = 600.0, pause: float = 0.2) -> None:
        self.spark, self.path, self.patience, self.pause = spark, f"{index.rstrip('/')}.writer", patience, pause
        self.token = secrets.token_hex(8)

    def _owner(self) -> dict | None:
        try:
            return json.loads(files.read_text(self.spark, self.path))
        except FileNotFoundError:
            return None
        except ValueError:
            return {}  # being written

    def __enter__(self) -> WriterLease:
        mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "token": self.token, "since": time.time()})
        deadline = time.monotonic() + self.patience
        while not files.create_text(self.spark, self.path, mine):
            owner = self._owner()
            if owner and _ended(owner):
                # renaming decides which of several waiting processes clears it
                aside = f"{self.path}.{self.token}"
                if files.rename(self.spark, self.path, aside):
                    files.remove(self.spark, aside)
                continue
            if time.monotonic() > deadline:
                raise TimeoutError(f"{self.path} is held by {owner}")
            time.sleep(self.pause)
        return self

    def __exit__(self, *_: object) -> None:
        owner = self._owner()
        if owner and owner.get("token") == self.token:
            files.remove(self.spark, self.path)
