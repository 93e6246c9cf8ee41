"""Schema migration: a registry of steps, and rows taken along the path from their version to a target."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The version of a record that names none.
DEFAULT_VERSION = "1.0.0"


@dataclass(frozen=True)
class Step:
    """One version to the next; `transform` changes a DataFrame of records at the first."""

    from_version: str
    to_version: str
    transform: Callable[[DataFrame], DataFrame]
    description: str = ""

    def __post_init__(self) -> None:
        if not self.from_version or not self.to_version or self.from_version == self.to_version:
            raise ValueError("a step leads from one version to another")


@dataclass
class Migrator:
    """Registered steps; paths are shortest, steps registered first are preferred."""

    steps: list[Step] = field(default_factory=list)

    def register(self, step: Step) -> None:
        if any((s.from_version, s.to_version) == (step.from_version, step.to_version) for s in self.steps):
            raise ValueError(f"a step from {step.from_version} to {step.to_version} is registered")
        self.steps.append(step)

    def find_path(self, start: str, target: str) -> list[Step] | None:
        came: dict[str, Step | None] = {start: None}
        queue = deque([start])
        while queue and target not in came:
            at = queue.popleft()
            for step in self.steps:
                if step.from_version == at and step.to_version not in came:
                    came[step.to_version] = step
                    queue.append(step.to_version)
        if target not in came:
            return None
        path: list[Step] = []
        while (step := came[target]) is not None:
            path.append(step)
            target = step.from_version
        return path[::-1]

    def has_path(self, start: str, target: str) -> bool:
        return self.find_path(start, target) is not None

    def versions(self) -> list[str]:
        """Every version that a step begins or ends with, as registered."""
        return list(dict.fromkeys(v for s in self.steps for v in (s.from_version, s.to_version)))

    def migrate(self, records: DataFrame, target: str) -> DataFrame:
        """Records at `target`, with `migrated_from`; a version without a path is an error.

        One projection per registered version that leads to `target`, put together; nothing is collected.
        A record at any other version makes the job fail when it is met, with its id and version.
        """
        if not target:
            raise ValueError("a target version is needed")
        if self.steps and target not in self.versions():
            raise ValueError(f"no step leads to {target}")
        known = {v: path for v in [*self.versions(), target] if (path := self.find_path(v, target)) is not None}
        rows = records.withColumn("schema_version", F.coalesce("schema_version", F.lit(DEFAULT_VERSION)))
        lost = F.concat(F.lit("record "), F.coalesce(F.col("id").cast("string"), F.lit("without id")) if "id" in records.columns else F.lit("?"), F.lit(": no path from "), F.col("schema_version"), F.lit(f" to {target}"))
        rows = rows.withColumn("schema_version", F.when(F.col("schema_version").isin(*known), F.col("schema_version")).otherwise(F.raise_error(lost).cast("string")))
        out = None
        for version, path in known.items():
            part = rows.where(F.col("schema_version") == version).withColumn("migrated_from", F.lit(version))
            for step in path:
                try:
                    part = step.transform(part)
                except Exception as error:
                    raise ValueError(f"the step from {step.from_version} to {step.to_version} fails: {error}") from error
                part = part.withColumn("schema_version", F.lit(step.to_version))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def steps_applied(self, migrated: DataFrame) -> DataFrame:
        """(from_version, to_version, records): the steps that touched a record of a migrated table."""
        taken = {(v, t): self.find_path(v, t) or [] for v in self.versions() for t in self.versions() if v != t}
        pairs = [(v, t, i, s.from_version, s.to_version) for (v, t), path in taken.items() for i, s in enumerate(path)]
        table = migrated.sparkSession.createDataFrame(pairs, "migrated_from string, schema_version string, step int, from_version string, to_version string")
        # At most one row per pair of registered versions.
        return counts(migrated).join(F.broadcast(table), ["migrated_from", "schema_version"]).groupBy("from_version", "to_version").agg(F.sum("records").alias("records"))


def counts(migrated: DataFrame) -> DataFrame:
    """(migrated_from, schema_version, records)."""
    return migrated.groupBy("migrated_from", "schema_version").agg(F.count("*").alias("records"))


def add_freshness(records: DataFrame) -> DataFrame:
    """The step to 1.1.0: a freshness score that isn't known yet."""
    return records if "freshness_score" in records.columns else records.withColumn("freshness_score", F.lit(None).cast("double"))


#: The version that ledger entries, taste cards and state snapshots are brought to before they are validated.
TRUSTED_VERSION = "1.1.0"


def upgraded(records: DataFrame) -> DataFrame:
    """Trusted records at the version that validation expects; tables without versions are left as they are.

    Versions that no step knows stay, so that the rules of rows can report them.
    """
    if "schema_version" not in records.columns:
        return records
    # The default steps only add a column, so all versions are one projection and the table is read once.
    version = F.coalesce("schema_version", F.lit(DEFAULT_VERSION))
    return add_freshness(records).withColumn("schema_version", F.when(version.isin(*default_migrator().versions()), TRUSTED_VERSION).otherwise(version))


def default_migrator() -> Migrator:
    migrator = Migrator()
    migrator.register(Step("1.0.0", "1.1.0", add_freshness, "adds freshness_score"))
    return migrator
