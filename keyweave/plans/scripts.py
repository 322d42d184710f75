"""Named functions in place of scripts: loaded once, called by the SHA-1 of their source."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable

from pyspark.sql import SparkSession


class NoScript(LookupError):
    """No function was loaded under this SHA-1."""


class Scripts:
    """Functions of (call, keys, args), where ``call(command, *args)`` runs an engine command.

    Nothing is interpreted: only functions the program itself loads can run, and
    their answers must be JSON.
    """

    def __init__(self, call: Callable) -> None:
        self._call = call
        self._loaded: dict[str, Callable] = {}

    def load(self, function: Callable) -> str:
        sha = hashlib.sha1(inspect.getsource(function).encode()).hexdigest()
        self._loaded[sha] = function
        return sha

    def exists(self, *shas: str) -> list[bool]:
        return [s in self._loaded for s in shas]

    def flush(self) -> int:
        n = len(self._loaded)
        self._loaded.clear()
        return n

    def evalsha(self, sha: str, keys: list[str], args: list):
        if sha not in self._loaded:
            raise NoScript(sha)
        return json.loads(json.dumps(self._loaded[sha](self._call, list(keys), list(args))))

    def kill(self, spark: SparkSession, tag: str) -> None:
        """Cancels the jobs a script runs under ``spark.addTag(tag)``."""
        spark.interruptTag(tag)

    def eval(self, function: Callable, keys: list[str], args: list):
        return self.evalsha(self.load(function), keys, args)
