"""Command line of the knowledge build: one JSON envelope on standard output, exit code 0 or 1.

    python -m factloom.cli prepare --vault V --knowledge-base ID --source DIR --job J
    python -m factloom.cli validate {evidence-claims|canonical-claims} --job J --claims FILE ...
    python -m factloom.cli suggest-alignments --job J [--threshold T]      (also: compile)
    python -m factloom.cli validate pages --job J --pages DIR --plan FILE
    python -m factloom.cli evaluate --job J --probes FILE --results FILE
    python -m factloom.cli publish --job J
    python -m factloom.cli {verify|lint} --vault V --knowledge-base ID

A job folder holds a table a record and job.json with its stage; a command runs only in the stages
that may come before it. Configuration belongs to the first build: another id or other roots are refused.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import incremental, rules, similarity
from factloom.plans import build, verify
from factloom.session import local_session
from factloom.sources import markdown, records

SIGNATURE = {"created_by": "factloom", "schema_version": schemas.VERSION}
#: Tables of a publication, as far as the job has them.
PUBLISHED = ("sources", "evidence_units", "evidence_spans", "files", "primary_anchors", "evidence_claims", "span_dispositions", "primary_support_reviews", "concepts", "canonical_status", "alignment_decisions", "page_plan", "pages", "page_records", "probes", "probe_results", "evaluation")

class CommandError(ValueError):
    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def target_of(vault: str, knowledge_base: str) -> str:
    if not os.path.isabs(vault):
        raise CommandError("VAULT_NOT_ABSOLUTE", vault)
    if not os.path.isdir(vault):
        raise CommandError("VAULT_NOT_FOUND", vault)
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]{1,62}", knowledge_base):
        raise CommandError("INVALID_KNOWLEDGE_BASE_ID", knowledge_base)
    return os.path.join(vault, knowledge_base)


def configure(target: str, knowledge_base: str, roots: list[str]) -> dict:
    """The configuration of a target; written by the first build, equal afterwards."""
    path = os.path.join(target, "factloom.json")
    if not os.path.exists(path):
        if os.path.isdir(target) and os.listdir(target):
            raise CommandError("TARGET_NOT_OWNED", f"{target} has files of someone else")
        if not roots:
            raise CommandError("SOURCE_REQUIRED", "the first build names its sources")
        config = {**SIGNATURE, "knowledge_base": knowledge_base, "roots": sorted(set(roots))}
        records.write_json_atomic(path, config)
        return config
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if {k: config.get(k) for k in SIGNATURE} != SIGNATURE or config.get("knowledge_base") != knowledge_base:
        raise CommandError("INVALID_CONFIG", path)
    if roots and set(roots) != set(config["roots"]):
        raise CommandError("CONFIG_CHANGE_REQUIRES_APPROVAL", "the roots differ from those of the first build")
    return config


def config_of(target: str) -> dict:
    with open(os.path.join(target, "factloom.json"), encoding="utf-8") as f:
        return json.load(f)


class Job:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @property
    def state(self) -> dict:
        try:
            with open(f"{self.root}/job.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            raise CommandError("MISSING_INPUT", f"{self.root} is no job") from None

    def enter(self, stage: str, **more) -> None:
        state = self.state if os.path.exists(f"{self.root}/job.json") else {}
        records.write_json_atomic(f"{self.root}/job.json", {**state, **more, "stage": stage})

    def require(self, command: str) -> None:
        if self.state["stage"] not in rules.STAGES[command]:
            raise CommandError("PUBLISH_GATE" if command == "publish" else "STAGE_GATE", f"{command} does not follow {self.state['stage']}")

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return os.path.exists(f"{self.root}/{name}/_SUCCESS")

    def tables(self, *names: str) -> build.Tables:
        return {n: self.read(n) for n in names if self.has(n)}

    def records(self, name: str, path: str | None) -> DataFrame:
        """Rows of a JSON Lines file, each as its schema demands."""
        if path is None or not os.path.exists(path):
            raise CommandError("MISSING_INPUT", name)
        good, bad = records.read_jsonl(self.spark, path, schemas.schema(name))
        build.gate(name, bad, schemas.violations(name, good))
        return good


def flat_claims(df: DataFrame) -> DataFrame:
    return df.select("*", "qualifiers.time", "qualifiers.scope", "qualifiers.conditions")


def prepare(spark: SparkSession, a) -> dict:
    target = target_of(a.vault, a.knowledge_base)
    config = configure(target, a.knowledge_base, a.source)
    found = markdown.discover(a.vault, target, config["roots"])
    if not found:
        raise CommandError("NO_SOURCES", "no Markdown below the roots")
    pub = records.Publication(spark, target)
    previous = {"sources": pub.read("sources")} if pub.current() else None
    t = build.prepare(markdown.read(spark, found, a.vault), previous)
    mark = incremental.build_fingerprint(t["sources"], version=schemas.VERSION, knowledge_base=a.knowledge_base, roots=config["roots"])
    if pub.current() and pub.current()["fingerprint"] == mark:
        return {"status": "noop", "build_id": pub.current()["build_id"]}
    job = Job(spark, a.job)
    for name, df in t.items():
        job.write(name, df)
    job.enter("prepared", vault=a.vault, target=target, knowledge_base=a.knowledge_base, fingerprint=mark, build_id=records.new_build_id())
    return {"status": "prepared", "build_id": job.state["build_id"], **counts(job)}


def counts(job: Job) -> dict:
    """How much a prepared job holds."""
    s = job.read("sources").agg(F.count("*").alias("source_count"), F.count_distinct("logical_source_id").alias("logical_source_count"), F.count_distinct("independence_group_id").alias("independence_group_count"))
    sums = {"unit_count": "evidence_units", "span_count": "evidence_spans", "anchor_count": "primary_anchors", "changed_source_count": "changed_sources", "deleted_source_count": "deleted_sources"}
    return {**s.first().asDict(), **{k: job.read(n).count() for k, n in sums.items()}}


def previous_build(job: Job) -> build.Tables | None:
    """What the current publication holds of claims, for those that carry over."""
    pub = records.Publication(job.spark, job.state["target"])
    there = set((pub.current() or {}).get("tables", ()))
    names = there & {"evidence_claims", "span_dispositions", "evidence_units", "primary_support_reviews"}
    return {n: pub.read(n) for n in names} if "evidence_claims" in there else None


def validate(spark: SparkSession, a) -> dict:
    job = Job(spark, a.job)
    job.require(a.what)
    base = job.tables("sources", "evidence_units", "evidence_spans", "work_units", "primary_anchors", "changed_sources", "deleted_sources")
    if a.what == "pages":
        return validate_pages(job, a)
    if a.what == "evidence-claims":
        claims, disp = flat_claims(job.records("evidence_claims", a.claims)), job.records("span_dispositions", a.dispositions)
        given = {"evidence_claims": claims, "span_dispositions": disp}
        if a.reviews:
            given["primary_support_reviews"] = job.records("primary_support_reviews", a.reviews)
        out = build.check_evidence({**base, **given}, previous_build(job))
        for name in ("evidence_claims", "span_dispositions", "provenance", "primary_support_reviews"):
            if name in out:
                job.write(name, out[name])
        job.enter("evidence-validated")
        return {"status": "evidence-validated", "claim_count": claims.count()}
    raw = flat_claims(job.records("canonical_claims", a.claims))
    names = {"supporting_evidence_claim_ids": "supporting", "opposing_evidence_claim_ids": "opposing", "derived_from_claim_ids": "derived_from"}
    canonical, concepts = raw.withColumnsRenamed(names), job.records("concepts", a.concepts)
    given = {"canonical_claims": canonical, "concepts": concepts}
    if a.decisions:
        given["alignment_decisions"] = job.records("alignment_decisions", a.decisions)
        job.write("alignment_decisions", given["alignment_decisions"])
    out = build.check_canonical({**base, **job.tables("evidence_claims", "provenance", "alignment_candidates"), **given})
    job.write("concepts", concepts)
    job.write("canonical_status", out["canonical_status"])
    job.enter("canonical-validated")
    return {"status": "canonical-validated", "statuses": {r.status: r.n for r in out["canonical_status"].groupBy("status").agg(F.count("*").alias("n")).collect()}}


def validate_pages(job: Job, a) -> dict:
    plan = job.records("page_plan", a.plan)
    found = markdown.read(job.spark, a.pages, os.path.abspath(a.pages)).select("path", "markdown")
    state = job.state
    out = build.check_pages({**job.tables("canonical_status", "concepts"), "pages": found, "page_plan": plan}, state["knowledge_base"], state["build_id"])
    for name in ("pages", "page_plan", "page_records"):
        job.write(name, out[name])
    job.enter("pages-validated")
    return {"status": "pages-validated", "page_count": plan.count(), "citation_closure": 1.0, "published_claim_coverage": 1.0}


def evaluate(spark: SparkSession, a) -> dict:
    job = Job(spark, a.job)
    job.require("evaluate")
    probes, results = job.records("probes", a.probes), job.records("probe_results", a.results)
    try:
        out = build.check_evaluation({**job.tables("canonical_status", "pages", "evidence_spans", "span_dispositions"), "probes": probes, "probe_results": results})
    except build.GateClosed as e:
        if e.violations[0].rule_code == "EVALUATION_BLOCKED":
            job.enter("evaluation-blocked")
        raise
    for name in ("probes", "probe_results", "evaluation"):
        job.write(name, out[name])
    job.enter("evaluation-passed")
    gold = probes.where("kind = 'gold'").count()
    return {"status": "evaluation-passed", "evaluation_level": "gold-reviewed" if gold else "diagnostic-only", "metrics": job.read("evaluation").first().asDict(), "probe_count": probes.count()}


def align(spark: SparkSession, a) -> dict:
    job = Job(spark, a.job)
    job.require("suggest-alignments")
    claims = job.read("evidence_claims")
    job.write("alignment_candidates", similarity.suggest(claims, a.threshold))
    return {"status": "alignments-suggested", "comparison_count": similarity.comparisons(claims).first()[0], "alignment_candidate_count": job.read("alignment_candidates").count()}


def publish(spark: SparkSession, a) -> dict:
    job = Job(spark, a.job)
    job.require("publish")
    state = job.state
    try:
        now = markdown.read(spark, markdown.discover(state["vault"], state["target"], config_of(state["target"])["roots"]) or [state["vault"]], state["vault"])
        done = build.publish(records.Publication(spark, state["target"]), job.tables(*PUBLISHED), state["fingerprint"], now, state["build_id"])
    except Exception:
        job.enter("publish-failed")
        raise
    job.enter("published", build_id=done["build_id"])
    return {"status": done["status"], "build_id": done["build_id"]}


def check(spark: SparkSession, a) -> dict:
    pub = records.Publication(spark, target_of(a.vault, a.knowledge_base))
    if pub.current() is None:
        raise CommandError("VERIFY_STATE", "nothing is published")
    state = pub.current()
    if state["manifest_sha256"] != records.manifest_digest(state):
        raise CommandError("VERIFY_MANIFEST", "the pointer differs from what was published")
    drifted = pub.drifted().select(F.lit("VERIFY_GENERATED_DRIFT").alias("rule_code"), F.col("path").alias("record_id"), F.col("drift").alias("detail"))
    build.gate("verify", drifted)
    build.gate("verify", verify.verify_tables({n: pub.read(n) for n in state["tables"]}))
    now = markdown.read(spark, markdown.discover(a.vault, pub.target, config_of(pub.target)["roots"]), a.vault)
    moved = incremental.drift(pub.read("sources").select("path", F.col("content_sha256").alias("sha256")), now.select("path", F.col("content_sha256").alias("sha256")))
    build.gate("verify", moved.select(F.lit("VERIFY_SOURCE_CHANGED").alias("rule_code"), F.col("path").alias("record_id"), F.col("drift").alias("detail")))
    return {"status": "lint-passed" if a.command == "lint" else "verified", "build_id": state["build_id"], "read_only": True}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("prepare")
    for name in ("--vault", "--knowledge-base", "--job"):
        c.add_argument(name, required=True)
    c.add_argument("--source", action="append", default=[])
    c.set_defaults(run=prepare)
    c = commands.add_parser("validate")
    c.add_argument("what", choices=["evidence-claims", "canonical-claims", "pages"])
    c.add_argument("--job", required=True)
    for name in ("--claims", "--dispositions", "--reviews", "--concepts", "--decisions", "--pages", "--plan"):
        c.add_argument(name)
    c.set_defaults(run=validate)
    c = commands.add_parser("evaluate")
    for name in ("--job", "--probes", "--results"):
        c.add_argument(name, required=True)
    c.set_defaults(run=evaluate)
    for name in ("suggest-alignments", "compile"):
        c = commands.add_parser(name)
        c.add_argument("--job", required=True)
        c.add_argument("--threshold", type=float, default=similarity.THRESHOLD)
        c.set_defaults(run=align)
    c = commands.add_parser("publish")
    c.add_argument("--job", required=True)
    c.set_defaults(run=publish)
    for name in ("verify", "lint"):
        c = commands.add_parser(name)
        c.add_argument("--vault", required=True)
        c.add_argument("--knowledge-base", required=True)
        c.set_defaults(run=check)
    return p


def run(spark: SparkSession, argv: list[str]) -> tuple[int, dict]:
    """(exit code, envelope) of a command."""
    try:
        a = parser().parse_args(argv)
        return 0, {"ok": True, **a.run(spark, a)}
    except build.GateClosed as e:
        return 1, {"ok": False, "error_code": e.violations[0].rule_code, "message": str(e), "violations": [r.asDict() for r in e.violations]}
    except CommandError as e:
        return 1, {"ok": False, "error_code": e.code, "message": str(e)}
    except ValueError as e:
        code = str(e).partition(":")[0]
        return 1, {"ok": False, "error_code": code if re.fullmatch("[A-Z_]+", code) else "INTERNAL_ERROR", "message": str(e)}


def main() -> int:
    code, envelope = run(local_session(), sys.argv[1:])
    print(json.dumps(envelope, ensure_ascii=False, sort_keys=True))
    return code


if __name__ == "__main__":
    sys.exit(main())
