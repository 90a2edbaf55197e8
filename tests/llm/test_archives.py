import base64
import hashlib

import pytest

from foldline.llm import chat, warc


def test_archive_round_trip(spark):
    rows = [(1, "http://a/ b", "same"), (5, None, "same"), (3, "http://c", "same"), (2, "http://d", None), (4, "http://e", ""), (6, "u", "x" * 300_000), (None, "http://n", "same"), (7, "http://é", "é\r\n\r\nWARC/1.1"), (5, "again", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS last", "3 AS payload", "4 AS refers_to")
    got = warc.archive(df, with_payload=True).collect()
    assert len(got) == len(rows)
    payloads = {1: "same", 5: "same", 3: "same", None: "same", 2: "", 4: "", 6: "x" * 300_000, 7: rows[7][2]}
    for r in got:
        body = payloads[r["page_id"]].encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        last = {"same": 5, "": 4}.get(payloads[r["page_id"]], r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == body)
    assert {r["record_type"] for r in warc.archive(df, least=10).filter("payload_bytes < 10").collect()} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0


def test_archive_is_framed_by_record(tmp_path):
    a = warc.Archive(f"{tmp_path}/a.zst", sample=5000)
    bodies = [warc.record(i, f"http://h/{i}", b"hello world %d " % i * 20, None, "2024-01-01T00:00:00Z") for i in range(200)]
    for b in bodies:
        a.add(b)
    a.close()
    assert list(warc.read_archive(f"{tmp_path}/a.zst", chunk=100)) == bodies
    with open(f"{tmp_path}/a.zst", "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.SKIPPABLE


def test_chat_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "assistant", None), (2, 5, None, "x"), (2, None, "user", ""), (None, 0, "user", "lost"), (1, 1, "assistant", nasty), (3, 0, "sys#:tem\\", "\n\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS loss", "2 AS n_turns")
    done = chat.format_chats(df)
    for r in done.collect():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert chat.read_turns(r["text"]) == [(x[2], x[3]) for x in own]
        learned = [chat.unescape(r["text"][s["start"] : s["stop"]]) for s in r["loss"]]
        assert learned == [x[3] for x in own if x[2] == "assistant"] and r["n_turns"] == len(own)
    got = {r["conv_id"]: r for r in chat.read_back(done).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256((nasty * 2).encode()).hexdigest() and got[1]["loss_chars"] == 52
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_template_language():
    t = chat.Template("{% set n = 0 + 2 %}{{ 'a' ~ (1 + 1) }}{% for m in messages %}{% if loop.first %}<{% elif m.role == \"user\" and not m.hidden %}u{% else %}-{% endif %}{{ m.text | trim | upper }}{% endfor %}{% if 1 == 2 %}no{% endif %}{# c #}")
    assert t.render([{"role": "user", "text": " x "}, {"role": "user", "text": "y"}, {"role": "a"}])[0] == "a2<XuY-"
    assert chat.fold(chat.parse("a{{ 'b' }}{% if true %}c{% endif %}")) == [("put", ("const", "abc"))]
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{% for x in y %}", "{% import os %}", "{{ x | open }}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ x.y }}").render([], x=object())
    text, marks = chat.Template("{% generation %}ab{% endgeneration %}c").render([])
    assert (text, marks) == ("abc", [(0, 2)])
