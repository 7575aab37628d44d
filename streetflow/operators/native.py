"""The searches of kernels in Java, by a helper process beside each Python worker that searches many trips.

Spark's own compiler makes the class on the driver, and its bytes travel with the graph, so executors need nothing but the
Java that they run on. Where the helper doesn't start, kernels' own searches run and give the same.
``STREETFLOW_NATIVE=0`` on the driver turns it off. The helper ends with its worker, or when another graph takes its place.
"""

from __future__ import annotations

import os
import pkgutil
import shutil
import subprocess
import tempfile

import numpy as np

#: Bytes of heap a node, a link, and beside them: what the graph takes, twice over. The limit leaves room for flags.
NODE, LINK, BASE, ROOM = 150, 100, 64_000_000, 4
_CODE: list[bytes] = []


def code() -> bytes:
    """The class of the searches, from Spark's compiler; empty without a running Spark."""
    from pyspark import SparkContext

    if os.environ.get("STREETFLOW_NATIVE") == "0" or SparkContext._active_spark_context is None:
        return b""
    if not _CODE:
        compiler = SparkContext._active_spark_context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__name__, "Search.java").decode())
        _CODE.append(bytes(compiler.getBytecodes().get("Search")))
    return _CODE[0]


def java() -> str | None:
    own = os.path.join(os.environ.get("JAVA_HOME", ""), "bin", "java")
    return own if os.access(own, os.X_OK) else shutil.which("java")


def start(g, compiled: bytes) -> Router | None:
    """A helper that holds the graph; None if there is none."""
    if not compiled or java() is None:
        return None
    try:
        return Router(g, compiled)
    except OSError:
        return None


class Router:
    """A helper process with a graph's links. Trips are sent to it and their paths come back."""

    def __init__(self, g, compiled: bytes):
        self.time = self.flags = None
        heap = ROOM * (NODE * len(g.ids) + LINK * len(g.u)) + BASE
        with tempfile.TemporaryDirectory(prefix="streetflow-") as d:
            with open(os.path.join(d, "Search.class"), "wb") as f:
                f.write(compiled)
            self.helper = subprocess.Popen(
                [java(), "-XX:+UseSerialGC", "-XX:MinHeapFreeRatio=10", "-XX:MaxHeapFreeRatio=30", "-XX:ReservedCodeCacheSize=24m", "-XX:-UsePerfData", "-XX:+UseTransparentHugePages", f"-Xmx{heap >> 10}k", "-cp", d, "Search"],
                stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={k: x for k, x in os.environ.items() if k != "JAVA_TOOL_OPTIONS"},
            )
            # Its answer comes after the class is read, so the folder may go then.
            self._send([len(g.ids), len(g.u), int(g.y is not None)], g.u, g.v, *((g.y, g.x) if g.y is not None else ()))
            self._flush()
            if self._read(1, np.int32)[0] != len(g.ids):
                raise OSError("the helper answers wrongly")

    def __del__(self):
        if hasattr(self, "helper"):
            self.helper.stdin.close()
            self.helper.stdout.close()
            self.helper.wait()

    def _send(self, ints: list[int], *arrays) -> None:
        self.helper.stdin.write(np.array(ints, "<i4").tobytes())
        for a in arrays:
            self.helper.stdin.write(memoryview(a).cast("B") if len(a) else b"")

    def _flush(self) -> None:
        self.helper.stdin.flush()

    def _read(self, count: int, kind) -> np.ndarray:
        out = np.empty(count, kind)
        if count and self.helper.stdout.readinto(out.view(np.uint8).data) != out.nbytes:
            raise OSError("the helper of the searches has ended")
        return out

    def _take(self, time) -> None:
        if time is not self.time:
            # Kept, so that no other array gets its place; so are the flags.
            self.time = time
            self._send([1], np.ascontiguousarray(time, "<f8"))

    def flags_of(self, nodes, time, target, regions: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides what kernels.flags_of gives, without the links' own regions. target: the column of each boundary node's region, else -1."""
        self._take(time)
        nodes, target = (np.ascontiguousarray(x, "<i4") for x in (nodes, target))
        found = []
        for side in range(2):
            self._send([4, side, len(nodes), regions], target, nodes)
            self._flush()
            links = self._read(int(self._read(1, np.int32)[0]), np.int32)
            found.append((links, self._read(len(links) * -(-regions // 8), np.uint8).reshape(len(links), -(-regions // 8))))
        return found

    def tree(self, node: int, time, reverse: bool, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(node numbers, costs) of kernels.tree."""
        self._take(time)
        self._send([5, int(reverse), most or 0, node])
        self._flush()
        count = int(self._read(1, np.int32)[0])
        return self._read(count, np.int32), self._read(count, np.float64)

    def routes(self, origin, dest, time, speed=None, flags=None, alike=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, number of links or -1, links of all paths) of trips between node numbers; -1 is no node."""
        self._take(time)
        if flags is not None and (self.flags is None or any(a is not b for a, b in zip(flags, self.flags))):
            self.flags = flags
            forward, backward, region = flags
            forward, backward = (x if x.dtype == np.uint8 else np.packbits(x, 1) for x in (forward, backward))
            self._send([2, forward.shape[1]], *(np.ascontiguousarray(x).ravel() for x in (forward, backward)), np.ascontiguousarray(region, "<i4"))
        self._send([3, len(origin), int(speed is not None), int(alike is not None), int(flags is not None)], np.array([speed or 1.0]),
                   *(np.ascontiguousarray(x, "<i4") for x in (origin, dest)), *([] if alike is None else [np.ascontiguousarray(alike, np.uint8)]))
        self._flush()
        cost, size = self._read(len(origin), np.float64), self._read(len(origin), np.int32)
        return cost, size, self._read(int(self._read(1, np.int32)[0]), np.int32)
