import json

from factloom import cli


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_a_build_from_the_command_line(spark, tmp_path):
    vault, job = tmp_path / "vault", str(tmp_path / "job")
    notes = vault / "notes"
    notes.mkdir(parents=True)
    (notes / "a.md").write_text("---\ntitle: A\nfactloom_source: user-authored\n---\n# F\n\nCaching helps.\n")
    (notes / "b.md").write_text("# F\n\nCaching never helps.\n")
    base = ["--vault", str(vault), "--knowledge-base", "kb"]
    call = lambda *argv: cli.run(spark, [str(x) for x in argv])
    assert call("prepare", *base[:3], "Bad Id", "--job", job)[1]["error_code"] == "INVALID_KNOWLEDGE_BASE_ID"
    assert call("prepare", *base, "--job", job)[1]["error_code"] == "SOURCE_REQUIRED"
    code, out = call("prepare", *base, "--source", notes, "--job", job)
    assert code == 0 and out["source_count"] == 2 and out["span_count"] == 2
    assert call("prepare", *base, "--source", vault, "--job", job)[1]["error_code"] == "CONFIG_CHANGE_REQUIRES_APPROVAL"
    assert call("publish", "--job", job)[1]["error_code"] == "PUBLISH_GATE"

    j = cli.Job(spark, job)
    tier = {r.source_id: r.evidence_tier for r in j.read("sources").collect()}
    unit = {r.evidence_unit_id: r.source_id for r in j.read("evidence_units").collect()}
    claims, disp = [], []
    for i, s in enumerate(j.read("evidence_spans").orderBy("content").collect()):
        claims.append({
            "evidence_claim_id": f"ec_claim{i}", "evidence_unit_id": s.evidence_unit_id, "evidence_span_id": s.evidence_span_id, "statement": s.content, "claim_type": "observation", "polarity": "negative" if "never" in s.content else "positive",
            "modality": "asserted", "subject": "Caching", "predicate": "helps", "object": "it", "qualifiers": {"conditions": []}, "evidence_origin": tier[unit[s.evidence_unit_id]], "primary_anchor_ids": [], "extraction_status": "supported", "supporting_excerpt": s.content})
        disp.append({"evidence_span_id": s.evidence_span_id, "evidence_unit_id": s.evidence_unit_id, "status": "extracted", "claim_ids": [f"ec_claim{i}"]})
    dispositions = write_lines(tmp_path / "d.jsonl", disp)
    broken = write_lines(tmp_path / "broken.jsonl", [{**claims[0], "polarity": "odd"}, claims[1]])
    assert call("validate", "evidence-claims", "--job", job, "--claims", broken, "--dispositions", dispositions)[1]["error_code"] == "INVALID_IR"
    part = write_lines(tmp_path / "part.jsonl", disp[:1])
    whole = write_lines(tmp_path / "c.jsonl", claims)
    assert "INCOMPLETE_SPAN_COVERAGE" in call("validate", "evidence-claims", "--job", job, "--claims", whole, "--dispositions", part)[1]["message"]
    assert call("validate", "evidence-claims", "--job", job, "--claims", whole, "--dispositions", dispositions)[1]["claim_count"] == 2
    assert call("compile", "--job", job)[1] == {"ok": True, "status": "alignments-suggested", "comparison_count": 1, "alignment_candidate_count": 1}
    found = j.read("alignment_candidates").first()
    assert found.candidate_relation == "possibly-conflicting"

    canonical = [{
        "canonical_claim_id": "cc_cache", "statement": "Caching helps.", "concept_ids": ["concept_cache"], "claim_type": "observation", "qualifiers": {"conditions": []}, "supporting_evidence_claim_ids": ["ec_claim0"],
        "opposing_evidence_claim_ids": ["ec_claim1"], "derived_from_claim_ids": [], "supersedes": [], "superseded_by": []}]
    concepts = [{"concept_id": "concept_cache", "preferred_label": "Cache", "aliases": [], "definition_claim_ids": ["cc_cache"], "claim_ids": ["cc_cache"], "related_concept_ids": [], "relation_types": [], "status": "active"}]
    review = {"alignment_candidate_id": found.alignment_candidate_id, "decision": "conflict", "reviewer_type": "human", "reviewer_id": "r", "rationale": "they disagree"}
    args = ["validate", "canonical-claims", "--job", job, "--claims", write_lines(tmp_path / "k.jsonl", canonical), "--concepts", write_lines(tmp_path / "n.jsonl", concepts)]
    assert call(*args)[1]["error_code"] == "ALIGNMENT_REVIEW_INCOMPLETE", "candidates for review need decisions"
    assert call(*args, "--decisions", write_lines(tmp_path / "w.jsonl", [{**review, "decision": "merge"}]))[1]["error_code"] in ("INVALID_ALIGNMENT_DECISION", "ALIGNMENT_DECISION_DRIFT")
    assert call(*args, "--decisions", write_lines(tmp_path / "r.jsonl", [review]))[1]["statuses"] == {"disputed": 1}
    assert call("verify", *base)[1]["error_code"] == "VERIFY_STATE"
    assert call("publish", "--job", job)[1]["error_code"] == "PUBLISH_GATE", "pages and evaluation come first"

    staged = tmp_path / "staged"
    staged.mkdir()
    build_id = j.state["build_id"]
    statuses = ("single-source", "multi-source", "disputed", "superseded", "derived", "derived-note-only", "insufficient-evidence")

    def page(path, page_id, kind, body, **more):
        counts = "".join(f"  {s}: {int(s == 'disputed')}\n" for s in statuses)
        head = {"knowledge_base": "kb", "page_id": page_id, "page_type": kind, "build_id": build_id, **more}
        text = "".join(f"{k}: {v}\n" for k, v in head.items())
        (staged / path).write_text(f"---\n{text}epistemic_summary:\n{counts}---\n{body}")

    cited = "Caching is disputed [^cc_cache]\n"
    body = f"# Cache\n\n## 核心主张\n\n{cited}\n## 前提与局限\n\n{cited}\n## 开放问题\n\nopen\n\n## 证据\n\n[^cc_cache]: two notes\n"
    plan = [{"page_id": "index", "page_type": "map", "path": "index.md", "title": "I", "claim_ids": ["cc_cache"], "concept_ids": []}, {"page_id": "cache", "page_type": "concept", "path": "cache.md", "title": "C", "claim_ids": ["cc_cache"], "concept_ids": ["concept_cache"]}]
    page("index.md", "index", "map", f"# All\n\n[cache](cache.md) {cited}\n## 证据\n\n[^cc_cache]: two notes\n")
    page("cache.md", "cache", "concept", body, extra="x")
    args = ["validate", "pages", "--job", job, "--pages", staged, "--plan", write_lines(tmp_path / "plan.jsonl", plan)]
    assert call(*args)[1]["error_code"] == "INVALID_PAGE_FRONTMATTER"
    page("cache.md", "cache", "concept", body.replace(cited + "\n## 前提", "uncited\n\n## 前提"))
    assert call(*args)[1]["error_code"] == "UNCITED_FACTUAL_BLOCK"
    page("cache.md", "cache", "concept", body.replace("is disputed", "helps"))
    assert call(*args)[1]["error_code"] == "HIDDEN_EPISTEMIC_STATUS"
    page("cache.md", "cache", "concept", body)
    assert call(*args)[1]["page_count"] == 2
    assert call("publish", "--job", job)[1]["error_code"] == "PUBLISH_GATE", "evaluation comes first"

    person = {"reviewer_type": "human", "reviewer_id": "r", "rationale": "read it all"}
    probes = [{"probe_id": "probe_one", "kind": "gold", "question": "?", "expected_behavior": "answer", "required_claim_ids": ["cc_cache"], "author_type": "human", "author_id": "a", "rationale": "asked often"}]
    answer = {"probe_id": "probe_one", "behavior": "answer", "answer": "It is disputed.", "cited_claim_ids": ["cc_cache"], "entailment_status": "verified", **person}
    asked = write_lines(tmp_path / "p.jsonl", probes)
    blocked = call("evaluate", "--job", job, "--probes", asked, "--results", write_lines(tmp_path / "bad.jsonl", [{**answer, "cited_claim_ids": []}]))[1]
    assert blocked["error_code"] == "EVALUATION_BLOCKED" and j.state["stage"] == "evaluation-blocked"
    assert call("publish", "--job", job)[1]["error_code"] == "PUBLISH_GATE"
    done = call("evaluate", "--job", job, "--probes", asked, "--results", write_lines(tmp_path / "good.jsonl", [answer]))[1]
    assert done["evaluation_level"] == "gold-reviewed" and done["metrics"]["citation_closure"] == 1.0

    (notes / "b.md").write_text("# F\n\nCaching never helps!\n")
    assert call("publish", "--job", job)[1]["error_code"] == "SOURCE_CHANGED" and j.state["stage"] == "publish-failed"
    (notes / "b.md").write_text("# F\n\nCaching never helps.\n")
    out = call("publish", "--job", job)[1]
    assert out["status"] == "published" and out["build_id"] == build_id
    assert call("lint", *base)[1]["status"] == "lint-passed" and call("verify", *base)[1]["status"] == "verified"
    pointer = vault / "kb" / "current.json"
    state = json.loads(pointer.read_text())
    pointer.write_text(json.dumps({**state, "fingerprint": "other"}))
    assert call("verify", *base)[1]["error_code"] == "VERIFY_MANIFEST"
    pointer.write_text(json.dumps(state))
    assert call("prepare", *base, "--job", str(tmp_path / "job2"))[1]["status"] == "noop"
    (notes / "b.md").write_text("# F\n\nChanged.\n")
    assert call("verify", *base)[1]["error_code"] == "VERIFY_SOURCE_CHANGED"
    job2 = str(tmp_path / "job2")
    assert call("prepare", *base, "--job", job2)[1]["changed_source_count"] == 1

    # what was said about the unchanged note carries over; only the changed one needs claims
    j2 = cli.Job(spark, job2)
    span = j2.read("evidence_spans").where("content = 'Changed.'").first()
    new = {**claims[1], "evidence_claim_id": "ec_new", "evidence_unit_id": span.evidence_unit_id, "evidence_span_id": span.evidence_span_id, "statement": "Changed.", "supporting_excerpt": "Changed."}
    told = [{"evidence_span_id": span.evidence_span_id, "evidence_unit_id": span.evidence_unit_id, "status": "extracted", "claim_ids": ["ec_new"]}]
    assert call("validate", "evidence-claims", "--job", job2, "--claims", write_lines(tmp_path / "c2.jsonl", [new]), "--dispositions", write_lines(tmp_path / "d2.jsonl", told))[0] == 0
    kept = next(c["evidence_claim_id"] for c in claims if "never" not in c["statement"])
    assert {r.evidence_claim_id for r in j2.read("evidence_claims").collect()} == {kept, "ec_new"}
    twin = write_lines(tmp_path / "c3.jsonl", [{**new, "evidence_claim_id": kept}])
    again = write_lines(tmp_path / "d3.jsonl", [{**told[0], "claim_ids": [kept]}])
    assert call("validate", "evidence-claims", "--job", job2, "--claims", twin, "--dispositions", again)[1]["error_code"] == "DUPLICATE_ID"
