import os

import pytest

from normlattice.llm import secrets

TEXTS = [
    ("see sk-0123456789abcdef01234567ABCDEFGHijklmnopQRSTuv now", "ABCDEFGHijklmnopQRSTuv"),
    ("url postgres://admin:Zx81kQpw77Lm4RtVbN@db.example.com/main here", "Zx81kQpw77Lm4RtVbN"),
    ("url postgres://" + "user" * 20 + ":Zx81kQpw7Lm4$RtVbN@db.example.com/main here", "Zx81kQpw7Lm4$RtVbN"),
    ("url amqp://a:Zx81k@Qpw77Lm4RtVbN9@[::1]:5672 here", "Qpw77Lm4RtVbN9"),
    ("url redis://:" + "Zx81kQpw7Lm4RtVbN9cD" * 40 + "@cache01 here", "Lm4RtVbN9cDZx81kQpw7"),
    ("the bearer kQzXvWpLmRtGbNsYhJdF and on", "kQzXvWpLmRtGbNsYhJdF"),
    ("then pw: Zx81kQpw7Lm and on", "Zx81kQpw7Lm"),
    ("at " + "/".join(["internal", "station"] * 6) + "/ghpa8Kd02mQpZ7xT4vBn91LsWq6EyRu3HcJ5gXt/" + "/".join(["lesson", "tender"] * 6) + " end", "a8Kd02mQpZ7xT4vBn91LsWq6EyRu3HcJ5gXt"),
]


def test_whole_secrets_are_masked():
    net = secrets.train()
    for text, secret in TEXTS:
        masked = secrets.mask(text, net)
        assert secret not in masked and "[secret]" in masked
    for text in ("the key: important thing", "a token is understanding here", "see http://www.example.com:8080/a/b", "at http://example.com:80 or me@example.com", "in http://:@", "is ://x:y@", "at " + "/".join(["internal", "station"] * 12) + " end"):
        assert secrets.mask(text, net) == text


def test_findings_of_the_tables_are_confirmed():
    """The labelled findings that the tables have are the patterns'; the network hasn't seen them."""
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    net, n, sure = secrets.train(), 0, 0
    for text in pq.read_table(path, columns=["text"]).column("text").to_pylist():
        base = secrets.base_spans(text or "")
        n, sure = n + len(base), sure + secrets.confirmed(text or "", base, net)
        assert secrets.scan_text(text or "", net) == base  # these documents have no other secret
    assert n > 20 and sure >= 0.95 * n
