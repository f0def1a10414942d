"""One object for the whole course: upload, schema, align, analyze, export."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compose, infer, profile
from .operators.align import AlignmentSpec, align, preview, visible
from .operators.rows import drop_empty, with_row_index
from .plans import analyses, layout
from .plans.base import AnalysisRequest, AnalysisResult, AnalysisValidationError, get, names
from .sources import files, sinks
from .store import DatasetStore, Store


@dataclass(frozen=True)
class ApiError(Exception):
    """status: as HTTP has it (400 bad request, 404 unknown id, 413 too large, 422 unusable data)."""

    status: int
    error: str
    detail: str


class Engine:
    def __init__(self, spark: SparkSession, root: str | Store, most_bytes: int = files.MOST_BYTES) -> None:
        """root: a folder, or a store of another kind. most_bytes: the largest file that upload() takes."""
        self.spark, self.most_bytes = spark, most_bytes
        self.store = root if isinstance(root, Store) else DatasetStore(spark, root)
        self.results: dict[str, AnalysisResult] = {}
        if not names():
            analyses.register_all()

    def health(self) -> dict[str, str]:
        return {"status": "healthy", "spark": self.spark.version}

    def upload(self, path: str) -> dict[str, Any]:
        """Read a file and store each of its tables; the first is the default sheet."""
        name = PurePosixPath(path).name
        found = self.spark.read.format("binaryFile").load(path).select("length").first()
        size = found.length if found else 0
        try:
            files.check_upload(name, size, self.most_bytes)
        except ValueError as e:
            raise ApiError(413 if "more than" in str(e) else 400, "upload refused", str(e)) from None
        if PurePosixPath(name).suffix.lower() in (".csv", ".tsv"):
            tables = {PurePosixPath(name).stem: files.read_csv(self.spark, path)}
        else:
            tables = files.read_file(self.spark, path).tables
        if not tables:
            raise ApiError(422, "no tables", f"{name} holds no table")
        file_id = uuid.uuid4().hex
        sheets = list(tables)
        for k, df in enumerate(tables.values()):
            self.store.put(f"{file_id}_{k}", drop_empty(with_row_index(df)))
        self.store.put_info(file_id, {"filename": name, "sheets": sheets})
        return {"file_id": file_id, "filename": name, "sheet_names": sheets, "default_sheet": sheets[0]}

    def table(self, file_id: str, sheet: str | None = None) -> DataFrame:
        try:
            sheets = self.store.info(file_id)["sheets"]
            return self.store.get(f"{file_id}_{sheets.index(sheet) if sheet else 0}")
        except (KeyError, ValueError):
            raise ApiError(404, "unknown table", f"{file_id} {sheet or ''}") from None

    def schema(self, file_id: str, sheet: str | None = None) -> dict[str, Any]:
        found = infer.detect(self.table(file_id, sheet))
        return {"file_id": file_id, "sheet_name": sheet, "columns": [asdict(c) for c in found.columns], "row_count": found.row_count, "column_count": len(found.columns), "preview": found.preview}

    def align(self, file_id: str, spec: AlignmentSpec, sheet: str | None = None) -> dict[str, Any]:
        aligned = align(self.table(file_id, sheet), spec)
        aligned_id = uuid.uuid4().hex
        stored = self.store.put(aligned_id, aligned.df, {"file_id": file_id})
        counts = {"total_rows_source": aligned.cast.count(), "total_rows_aligned": stored.count(), "coercion_errors_count": aligned.errors.count()}
        counts["filtered_out_rows"] = counts["total_rows_source"] - counts["total_rows_aligned"]
        samples = [r.asDict() for r in aligned.errors.orderBy("row_index", "column").limit(10).collect()]
        return {"aligned_id": aligned_id, **counts, "coercion_error_samples": samples, "columns": visible(stored), "aligned_preview": preview(stored)}

    def analyze(self, aligned_id: str, request: AnalysisRequest) -> AnalysisResult:
        try:
            df = self.store.get(aligned_id)
        except KeyError:
            raise ApiError(404, "unknown id", aligned_id) from None
        try:
            strategy = get(request.analysis_type)
        except KeyError as e:
            raise ApiError(400, "unknown analysis", str(e)) from None
        try:
            result = strategy.analyze(df, request)
        except AnalysisValidationError as e:
            raise ApiError(422, "analysis failed", str(e)) from None
        result.metadata["aligned_id"] = aligned_id
        self.results[result.result_id] = result
        self.store.put_info(result.result_id, {"analysis": result.to_dict(rows=100)})
        return result

    def export(self, id_: str, kind: str = "csv", most_rows: int = sinks.MOST_ROWS) -> bytes:
        """The aligned rows of an analysis or aligned id as one file, if they are no more than most_rows; see export_table()."""
        result = self.results.get(id_)
        if kind not in sinks.FORMATS[:3]:
            raise ApiError(400, "unknown format", kind)
        try:
            df = self.store.get(result.metadata["aligned_id"] if result else id_)
        except KeyError:
            raise ApiError(404, "unknown id", id_) from None
        if df.count() > most_rows:
            raise ApiError(413, "too many rows for one file", f"{id_}: more than {most_rows}; use export_table")
        return sinks.to_csv(df) if kind == "csv" else (sinks.to_json if kind == "json" else sinks.to_xlsx)(df, result)

    def export_table(self, id_: str, path: str, kind: str = "parquet") -> None:
        """The aligned rows of an analysis or aligned id as a folder of files, written in parallel: for results of any size."""
        result = self.results.get(id_)
        if kind not in ("parquet", "csv", "json", "orc"):
            raise ApiError(400, "unknown format", kind)
        try:
            df = self.store.get(result.metadata["aligned_id"] if result else id_)
        except KeyError:
            raise ApiError(404, "unknown id", id_) from None
        sinks.write_table(df, path, kind)

    def profile_file(self, path: str) -> tuple[list[profile.TableProfile], compose.Composition, layout.LayoutPlan]:
        """The universal course: any file's tables, profiled, composed and laid out."""
        found = files.read_file(self.spark, path)
        profiles = [profile.profile(df, name) for name, df in found.tables.items()]
        unparsed = found.unparsed.agg(F.count("*")).first()[0] if found.unparsed is not None else 0
        return profiles, compose.compose(profiles, unparsed), layout.plan(profiles)
