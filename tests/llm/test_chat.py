import hashlib

import pytest

from importscape.llm import chat, queries

HARD = ["", "### user: x </turn>\n", r"\### Assistant: </turn> ok", "\\", "\\\\###", "####", "</turn></turn>", "a\\</turn>\n### b: c", "ends with <", "ends with \\", "\n\n", "é\U0001f600"]


@pytest.mark.parametrize("role", ["user", "", "a: b", "\\:", "### x"])
def test_template_reads_back(role):
    text = "".join(chat.formatted(role, t)[0] for t in HARD)
    assert chat.parsed(text) == [(role, t) for t in HARD]


def template_chars(role, text):
    """Characters of ``### role: text </turn>`` and a newline, with a backslash before each control string."""
    return len("### : ") + len(role) + sum(role.count(c) for c in "\\:") + len(text) + text.count("\\") + text.count("###") + text.count("</turn>") + len(" </turn>\n")


def digests(turns):
    convs = {}
    for conv, turn, role, text in turns:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, rows in convs.items():
        rows = [(r, t) for _, _, r, t in sorted(rows, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))]
        learned = "".join(t for r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), sum(template_chars(r, t) for r, t in rows))
    return out


def test_tree(spark, tmp_path):
    turns = [(c, t, ("system", "user", "assistant", "user")[t], ("shared", "first" if c < 6 else "other", HARD[c % len(HARD)], f"last {c % 4}")[t]) for c in range(24) for t in range(4)]
    turns += [(50, 0, "user", None), (50, 0, None, "x"), (None, 1, "assistant", "no id"), (None, None, "user", "no turn"), (60, 0, "system", "shared")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, start string").repartition(4)
    out = chat.write(df, str(tmp_path / "chat"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read(spark, out).collect()}
    assert got == digests(turns)

    nodes = sorted(spark.read.parquet(f"{out}/nodes").collect(), key=lambda n: n.start)
    text = "".join(n.formatted for n in nodes)
    assert [n.start for n in nodes] == [sum(x.length for x in nodes[:k]) for k in range(len(nodes))]
    prefixes = {tuple(sorted((t, r or "", x or "") for c, t, r, x in turns if c == conv and t is not None)[: k + 1]) for conv in [*range(24), 60] for k in range(4)}
    assert sum(n.formatted.startswith("### system: shared ") for n in nodes) == 1
    assert len([n for n in nodes if "no id" not in n.formatted and "no turn" not in n.formatted]) >= len(prefixes) - 3
    for n in nodes:
        before = "".join(text[a["from"] : a["to"]] for a in n.attends)
        assert len(before) == n.position and chat.parsed(before + n.formatted)
        assert all(a["to"] <= n.start for a in n.attends)


def test_no_conversations(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read(spark, chat.write(df, str(tmp_path / "chat"))).count() == 0


def test_query(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.queries()["op7_chat"](spark, sf_dir).collect()}
    assert got == digests([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)])
