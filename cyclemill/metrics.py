"""What a run took: wall time, the driver's processor time and memory, rows a second."""

from __future__ import annotations

import json
import resource
import time


class Measured:
    """with Measured() as m: ...; m.line(rows=...) is a JSON line. Executors' work is in Spark's own event log."""

    def __enter__(self) -> Measured:
        self._wall, self._cpu = time.perf_counter(), time.process_time()
        self.wall_s = self.cpu_s = 0.0
        return self

    def __exit__(self, *_) -> None:
        self.wall_s, self.cpu_s = time.perf_counter() - self._wall, time.process_time() - self._cpu

    def line(self, rows: int | None = None, **more) -> str:
        """more: what else the line says, before the figures."""
        took = {"wall_s": round(self.wall_s, 3), "driver_cpu_s": round(self.cpu_s, 3), "driver_rss_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)}
        if rows is not None:
            took |= {"rows": rows, "rows_per_s": round(rows / self.wall_s, 1) if self.wall_s > 0 else None}
        return json.dumps(more | took)
