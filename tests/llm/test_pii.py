import hashlib
import re

from tessitura.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


CARD = "4111 1111 1111 1111"
TEXTS = [
    "mail a.b+c@d-e.example.org, x@y, @z.w q@r.s.t-u%v@w.x..y a@b@c.d @@e@f.g.",
    "é👍 1.2.3.4.5 300.1.2.3 1.2.3 0001.02.003.255 999.1.1.1.7.7.7 12.3.4.5",
    f"Card {CARD}, 4111111111111112 4111-1111-1111-1111 1 2 5 500000000000000000000009 37828224631000500",
    "+1 (788) 555-0037 +49 30 1234567-8 +1 2 +12345678901234567890 ++1 555 555 5555 0 +1   ",
    "", "no data at all", "x" * 5000 + "@" + "y" * 50, "1" * 5000, "+1" + " " * 3000, "@" * 2000 + "a@b.c",
    "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, DE89370400440532013001",
    "SSN 078-05-1120, part 078-05-1120 of, ssn 000-12-3456",
    "call 030 1234567 or (555) 123-4567; order 030 1234567",
    'token = "f588a13e8ab71b41a6803e722e76d21eb69539fa" and f588a13e8ab71b41a6803e722e76d21eb69539fa' + " plain words go on" * 9,
]


def test_base_spans_against_plain(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(90, None, 1), (None, "a@b.c", 1), (3, TEXTS[3], 1), (91, "word 1.2.3.4 " * 40_000, 1)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert len(got) == len(rows)
    want = sorted(str((i, plain_base(t or ""))) for i, t, _ in rows)
    assert sorted(str((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base])) for r in got) == want
    for r in got:
        starts = [s.start for s in r.spans]
        assert starts == sorted(starts) and all(0 <= s.score <= 1 for s in r.spans)
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_validators_and_context_add_spans():
    added = lambda t: [(t[s:e], k) for k, s, e, _, base in pii.spans_of(t) if not base]
    assert added(TEXTS[10]) == [("GB82 WEST 1234 5698 7654 32", "account"), ("DE89370400440532013000", "account")]
    assert added("SSN 078-05-1120") == [("078-05-1120", "national")] and added("the part 078-05-1120") == [] == added("ssn 000-12-3456")
    assert [t for t, _ in added("call 030 1234567 or (555) 123-4567")] == ["030 1234567", "(555) 123-4567"] and added("in 030 1234567 we") == []
    assert [k for _, k in added(TEXTS[13])] == ["secret"]
    assert added("visa 4222222222222") == [("4222222222222", "short_card")] and added("isbn 4222222222222") == []
    card = next(s for s in pii.spans_of(f"my visa card {CARD}") if s[0] == "card")
    assert card[3] > next(s for s in pii.spans_of(f"order {CARD}") if s[0] == "card")[3]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")


def test_redaction(spark):
    text = f"é write a@b.c or {CARD}!"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), redact=True).first()
    assert r.redacted == "é write [EMAIL] or [CARD]!"
    assert pii.redacted("ab 1", []) == "ab 1"


def test_query_against_plain(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        spans = plain_base(t or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in PATTERNS]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(",")) and len(r.scores.split(",")) == len(r.spans.split(","))
