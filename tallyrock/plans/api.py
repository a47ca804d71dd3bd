"""What a serving process calls: health, run and jobs over a run's folder, as plain values with a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import enrich, filters
from ..sources import store


class Api:
    def __init__(self, spark: SparkSession, root: str, seed: str | None = None):
        self.spark, self.root, self.seed = spark, root, seed

    def health(self) -> tuple[int, dict]:
        return 200, {"ok": True, "rows": store.rows_exist(self.spark, f"{self.root}/rows")}

    def run(self) -> tuple[int, dict]:
        found = store.load_summary(self.spark, f"{self.root}/summary", self.seed)
        return 200, {"summary": found[0] if found else None, "source": found[1] if found else "none"}

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(store.Versions(self.spark, f"{self.root}/rows").path())

    def jobs(self, page=None, size=None, **by) -> tuple[int, dict]:
        """A page of rows. Until there are any, 503."""
        if not store.rows_exist(self.spark, f"{self.root}/rows"):
            return 503, {"error": "there has been no run yet"}
        found = store.load_summary(self.spark, f"{self.root}/summary")
        flow = found[0].get("incoming", {}) if found else {}
        ctx = filters.Context(str(flow.get("today") or (found[0]["run_at"][:10] if found else "1970-01-01")), flow.get("since"))
        try:
            out = filters.query(self.rows(), ctx, page, size, **by)
        except ValueError as e:
            return 400, {"error": str(e)}
        items = enrich.served(out["items"])
        return 200, {**out, "items": [r.asDict(recursive=True) for r in items.collect()]}  # one page

    def get(self, method: str, path: str, query: dict[str, str]) -> tuple[int, dict]:
        """Routes of the HTTP service: GET /api/health, /api/run and /api/jobs."""
        if method != "GET":
            return 405, {"error": "only GET"}
        if path == "/api/jobs":
            return self.jobs(**query)
        route = {"/api/health": self.health, "/api/run": self.run}.get(path)
        return route() if route else (404, {"error": "not found"})
