"""Projects: a small JSON manifest of files and what is known of them, the sample table, discovery of inputs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from spectralake.sources import exports

DEFAULTS = {"sample_type": "Sample", "group": "1", "batch": 1, "injection_order": None, "included": True}
KINDS = ("Sample", "QC", "Blank")


def normalised(metadata: dict) -> dict:
    """Defaults filled in; an unknown role or a batch below 1 is an error."""
    out = DEFAULTS | {k: v for k, v in metadata.items() if k in DEFAULTS}
    out["group"], out["batch"], out["included"] = str(out["group"]).strip() or "1", int(out["batch"]), bool(out["included"])
    if out["sample_type"] not in KINDS or out["batch"] < 1:
        raise ValueError("sample_type must be Sample, QC or Blank and batch at least 1")
    return out


@dataclass
class Project:
    name: str
    mode: str
    files: dict[str, dict] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("positive", "negative"):
            raise ValueError("mode must be positive or negative")
        self.files = {path: normalised(m) for path, m in self.files.items()}

    def save(self, spark: SparkSession, folder: str) -> None:
        exports._put(spark, f"{folder}/project.json", json.dumps(asdict(self), ensure_ascii=False, sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Project:
        return cls(**json.loads(exports._get(spark, f"{folder}/project.json")))

    def samples(self, spark: SparkSession) -> DataFrame:
        rows = [(path.rsplit("/", 1)[-1], path, *(m[k] for k in DEFAULTS)) for path, m in self.files.items()]
        return spark.createDataFrame(rows, "source_file string, source_path string, sample_type string, group string, batch int, injection_order int, included boolean")


def discover(spark: SparkSession, inputs: list[str], suffix: str = ".mzml") -> list[str]:
    """Files with the suffix (whatever its case) among files and directly below folders, by name; an error if a source has none."""
    found: dict[str, str] = {}
    for one in inputs:
        at = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(one)
        own = [s.getPath().toString() for s in fs.listStatus(at) if s.isFile()]
        fit = [p for p in own if p.lower().endswith(suffix)]
        if not fit:
            raise FileNotFoundError(f"no file ending with {suffix}: {one}")
        found |= {p.lower(): p for p in fit}
    return sorted(found.values(), key=lambda p: p.rsplit("/", 1)[-1].lower())
