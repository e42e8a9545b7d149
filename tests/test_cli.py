"""The command line on a small vault."""

import json

from tidepool import fixtures as X
from tidepool.api import scan_vault
from tidepool.cli import main


def vault(tmp_path):
    root = tmp_path / "vault"
    for rel, body in X.VAULT:
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, newline="")
    return str(root)


def test_notes(spark, tmp_path, capsys):
    root = vault(tmp_path)
    assert main(["notes", root, "--plan"]) == 0
    assert main(["notes", root, "--json", "--map", f"{tmp_path}/map", "--review-pile", f"{tmp_path}/pile"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {r["path"] for r in rows} == {r for r, _ in X.VAULT}
    top = {r.folder: r for r in spark.read.json(f"{tmp_path}/map").collect()}
    assert top["./"].notes == len(X.VAULT) and top["notes/"].notes == 11
    assert top["./"].judged == len(X.VAULT) - 2 and top["keys/"].local == 1 and top["./"].withheld == 2 and (top["./"].skipped.hidden, top["./"].skipped.sensitive) == (1, 1)
    assert "keys/k.md" in "".join(r.value for r in spark.read.text(f"{tmp_path}/pile").collect())


def test_journal_resume_and_refusal(spark, tmp_path):
    root, journal = vault(tmp_path), f"file://{tmp_path}/journal"
    rows, end = scan_vault(spark, root, journal=journal)
    assert end["reason"] == "done" and rows.count() == len(X.VAULT)
    again, _ = scan_vault(spark, root, journal=journal, resume=end["run_id"])
    rows, again = ({r.path: r for r in df.collect()} for df in (rows, again))
    assert set(again) == set(rows) and {r.cached for r in again.values() if r.judge == "judged"} == {True}
    for path, was in rows.items():
        now = again[path]
        assert (now.kind, now.judge, now.bucket, now.action, now.exact_duplicate_of, now.redacted) == (was.kind, was.judge, was.bucket, was.action, was.exact_duplicate_of, was.redacted)
    assert main(["notes", "/srv/private/vault"]) == 1


def test_records(tmp_path, capsys):
    data, questions = tmp_path / "r.jsonl", tmp_path / "q.yaml"
    data.write_text("\n".join(X.RECORDS))
    questions.write_text("questions:\n  lane:\n    type: choice\n    options: {a: x, b: y}\n")
    assert main(["records", f"file://{data}", "--questions", str(questions), "--json"]) == 0
    assert '"pick":"a"' in capsys.readouterr().out
    data.write_text("nonsense")
    assert main(["records", f"file://{data}", "--questions", str(questions)]) == 1
