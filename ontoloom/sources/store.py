"""A store of document collections as versioned Parquet snapshots.

root/<collection>/v=<n> holds snapshot n, complete. root/_commits/<n>.json names the current snapshot of every collection
and its validator; a change of several collections writes all their snapshots first and then one commit, so a job that dies
half-way changes nothing. Two writers can't make the same commit: the file is created without overwriting. Paths go
through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.operators import documents as D


class Blocked(ValueError):
    """A delete that references or constraints forbid."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _commits(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self._list(f"{self.root}/_commits") if x.endswith(".json") and x[:-5].isdigit())

    def state(self, commit: int | None = None) -> dict:
        """{"collections": {name: snapshot}, "validators": {name: JSON schema}, "meta": {...}} of a commit, by default the last one."""
        known = self._commits()
        if not known:
            return {"collections": {}, "validators": {}, "meta": {}}
        p, fs = self._path(f"{self.root}/_commits/{known[-1] if commit is None else commit}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, changed: dict[str, DataFrame] | None = None, dropped: list[str] = (), validators: dict[str, str] | None = None, meta: dict | None = None) -> dict[str, int]:
        """New snapshots of the changed collections, and one commit over all; gives the snapshots' numbers."""
        before = self._commits()
        state, made = self.state(), {}
        for name, docs in (changed or {}).items():
            made[name] = max([int(x[2:]) for x in self._list(f"{self.root}/{name}") if x.startswith("v=")], default=0) + 1
            docs.write.parquet(f"{self.root}/{name}/v={made[name]}")
        kept = {k: v for k, v in (state["collections"] | made).items() if k not in dropped}
        rules = {k: v for k, v in (state["validators"] | (validators or {})).items() if k not in dropped}
        text = json.dumps({"collections": kept, "validators": rules, "meta": state["meta"] if meta is None else meta}, sort_keys=True)
        number = max(before, default=0) + 1
        draft, fs = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._path(f"{self.root}/_commits/{number}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError("another writer has made this commit")
        return made

    def collections(self) -> list[str]:
        return sorted(self.state()["collections"])

    def versions(self, name: str) -> list[int]:
        return sorted(int(x[2:]) for x in self._list(f"{self.root}/{name}") if x.startswith("v=") and "_SUCCESS" in self._list(f"{self.root}/{name}/{x}"))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={self.state()['collections'][name] if version is None else version}")

    def ensure(self, validators: dict[str, str], columns: str = "_id string, _ontology_type string") -> None:
        """Sees to it that the collections exist, new ones with these columns, and sets their validators."""
        have = self.state()["collections"]
        new = {n: self.spark.createDataFrame([], columns) for n in validators if n not in have}
        self.commit(new, validators=validators)

    def drop(self, *names: str) -> None:
        """Drops collections, or all of them where none is named. Their snapshots stay readable by version."""
        self.commit(dropped=list(names) or self.collections())

    def write_meta(self, **facts) -> dict:
        """Replaces the store's own record: the facts, the collections' names and their number."""
        names = self.collections()
        meta = facts | {"collections": names, "collection_count": len(names)}
        self.commit(meta=meta)
        return meta

    def replace(self, name: str, docs: DataFrame) -> int:
        return self.commit({name: docs})[name]

    def insert(self, name: str, docs: DataFrame, issues: DataFrame | None = None) -> int:
        """Fails on ids that exist already or repeat, and on issues (of ontoloom.operators.validation)."""
        if issues is not None:
            from ontoloom.operators.validation import require_valid

            require_valid(issues)
        old = self.read(name) if name in self.collections() else None
        if not D.duplicate_keys(docs, "_id").isEmpty() or old is not None and not docs.join(old.select("_id"), "_id", "left_semi").isEmpty():
            raise ValueError("duplicate_object_id")
        return self.replace(name, docs if old is None else old.unionByName(docs, allowMissingColumns=True))

    def upsert(self, name: str, docs: DataFrame) -> int:
        return self.replace(name, D.upsert(self.read(name), docs, "_id") if name in self.collections() else docs)

    def update(self, name: str, changes: DataFrame) -> int:
        return self.replace(name, D.patch(self.read(name), changes, "_id"))

    def expand(self, name: str, references: list[D.Reference], query: dict | None = None, limit: int | None = 50, depth: int = 1, metadata: bool = True) -> DataFrame:
        """find() with references expanded."""
        found = D.expand(D.find(self.read(name), query, limit=limit), name, references, self.read, depth)
        return found if metadata else D.without_metadata(found)

    def preview_delete(self, name: str, ids: DataFrame, referrers: list[tuple[str, str, str]] = (), mode: str = "restrict") -> DataFrame:
        """(level, code, _id, collection, field, policy, action, n, examples): what a delete of ids (_id) would do or why it fails. referrers: (collection, field, policy)."""
        mode = D.normal_mode(mode)
        wanted = ids.select("_id").distinct()
        null = lambda t: F.lit(None).cast(t)
        row = lambda level, code: [F.lit(level).alias("level"), F.lit(code).alias("code"), F.col("_id").cast("string").alias("_id")]
        rest = [null("string").alias(c) for c in ("collection", "field", "policy", "action")] + [null("bigint").alias("n"), null("array<string>").alias("examples")]
        if mode not in D.MODES:
            return wanted.select(*row("error", "unknown_delete_mode"), *rest)
        out = wanted.join(self.read(name).select("_id"), "_id", "left_anti").select(*row("error", "document_not_found"), *rest)
        for other, field, policy in referrers:
            docs = self.read(other)
            array = docs.schema[field].dataType.typeName() == "array"
            action, why = D.effective_action(mode, policy, array)
            found = D.incoming_examples(wanted, "_id", [(other, docs, field, "_id")])
            level = "error" if action == "block" else "warning" if why else "info"
            out = out.unionByName(found.select(*row(level, why or "reference_detached"), F.lit(other).alias("collection"), "field", F.lit(policy).alias("policy"), F.lit(action).alias("action"), "n", "examples"))
        return out

    def suggest_mode(self, name: str, ids: DataFrame, referrers: list[tuple[str, str, str]] = ()) -> str | None:
        """The mildest mode in which the delete would go through."""
        return next((m for m in D.MODES if self.preview_delete(name, ids, referrers, m).where("level = 'error' and code != 'document_not_found'").isEmpty()), None)

    def delete(self, name: str, ids: DataFrame, referrers: list[tuple[str, str, str]] = (), mode: str = "restrict", check=None, now=None) -> dict[str, int]:
        """Deletes ids (_id) and detaches what refers to them, all in one commit; gives the new snapshots.

        referrers: (collection, field, policy). Blocked deletes raise Blocked; else fields that point to the ids become null
        or lose these items, all fields of a collection together. In the mode detach_if_valid, check(collection, documents)
        may give issues of the changed documents, and any raises Blocked. now: the metadata.updatedAt of changed documents.
        """
        mode = D.normal_mode(mode)
        ids = ids.select("_id").distinct()
        stops = self.preview_delete(name, ids, referrers, mode).where("level = 'error' and code != 'document_not_found'").select("code").distinct().collect()
        if stops:
            raise Blocked(", ".join(sorted(r[0] for r in stops)))
        changed: dict[str, DataFrame] = {}
        for other, field, _ in referrers:
            changed[other] = D.detach(changed.get(other, self.read(other)), field, ids, now)
        if mode == "detach_if_valid" and check is not None:
            for other, docs in changed.items():
                if not check(other, docs).isEmpty():
                    raise Blocked("detach_would_violate_constraints")
        changed[name] = changed.get(name, self.read(name)).join(ids, "_id", "left_anti")
        return self.commit(changed)
