import hashlib
import random
import re

from docfields.llm import secrets
from tests_llm_help import ODD_ROWS, prose, rows_of

_CHOOSER = random.Random(8)
KEY = "".join(_CHOOSER.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))


def brute_base(text):
    """The contract's patterns, word for word."""
    text = text or ""
    found = []
    kinds = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    )
    for place, (kind, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


TEXTS = [
    'password = "hunter2x"', "PassWD: abc", "token=token=abcdef secret='12345'", "api_key : A.b-C/d+e=f_g", "APIKEY=abcdef", "apikey =\tabcdef",
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIA" + "0" * 30 + "z", "f" * 23 + " " + "0" * 24 + "g" + "a1" * 40, "é🙂 token = " + "deadbeef" * 5,
    "tokens = abcdefgh", "secret\n=abcdefgh", "passwordpassword=abcdef", "ſecret=abcdefg toKen=abcdefg",
]


def test_base_equals_brute_force(spark):
    texts = [*TEXTS, *[r[1] for r in ODD_ROWS], " ".join(TEXTS)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for (_, text), row in zip(enumerate(texts), secrets.find_secrets(table).orderBy("doc_id").collect(), strict=True):
        expected = brute_base(text)
        assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), text
        assert [s for s in row.spans.split(",") if s and not s.startswith("novel")] == expected
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s.startswith(k) for s in expected) for k in ("assign", "access", "hex"))


def test_incompressible_strings_in_sensitive_context_are_reported():
    text = f"The authorization value we use is {KEY} for now."
    at = text.index(KEY)
    assert secrets.listed(secrets.scan(text)[1]) == f"novel:{at}:{at + 40}"
    for harmless in (
        f"The harmless value we use is {KEY} for now.",
        "authorization: https://www.example.com/index.html/application/json",
        "the private static void getElementById-addEventListener-createElement call",
        "credential " + "xy" * 30, f"{KEY} was seen; its auth copy {KEY} follows", prose(1, 200) + " auth " + prose(2, 200),
    ):
        assert secrets.scan(harmless)[1] == [], harmless


def test_base_spans_stay_and_are_not_reported_twice():
    text = f"secret = {KEY} and auth {KEY[::-1]}"
    base, every = secrets.scan(text)
    assert [s.kind for s in base] == ["assign"] and [s.kind for s in every] == ["assign", "novel"]


def test_very_long_candidates_and_many_words_take_linear_time():
    text = "auth " + KEY * 5000 + " key" * 20_000
    assert len(secrets.scan(text)[1]) <= 1


def test_odd_rows(odd, clashing, nothing):
    assert rows_of(secrets.find_secrets(odd)) == rows_of(secrets.find_secrets(clashing))
    assert secrets.find_secrets(odd).count() == len(ODD_ROWS)
    assert secrets.find_secrets(nothing).count() == 0


def test_values_right_behind_their_names_are_reported():
    for name in (
        "auth=", "auth:", "pwd=", "private_key=", "secret_key=", "SIGNING_KEY=", "key: ", "accessKey=", "accessKey: ", '"accessKey":"',
        "AWSSecretKey=", "https://www.example.com/?auth=", "key_of_the_production_environment=", "auth-", "auth_",
    ):
        for value in (KEY, KEY + "=="):
            text = f"{name}{value}"
            assert secrets.listed(secrets.scan(text)[1]) == f"novel:{len(name)}:{len(text)}", text
    for harmless in (f"monkey={KEY}", f"MONKEY={KEY}", "auth=0000000000000000", "key_of_the_production_environment=development"):
        assert secrets.scan(harmless)[1] == [], harmless


def test_incompressible_strings_of_few_kinds_of_characters_are_reported():
    chooser = random.Random(3)
    for letters in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmNOPQRSTUVWXYZ"):
        for size in (16, 24, 40, 64, 100, 400, 3000, 10_000):
            for _ in range(10):
                value = "".join(chooser.choice(letters) for _ in range(size))
                text = f"The authorization value we use is {value} for now."
                found = [s for s in secrets.scan(text)[1] if s.kind == "novel"]
                covered = [s for s in secrets.scan(text)[0]]
                assert covered or [(s.start, s.end) for s in found] == [(34, 34 + size)], value


def test_words_and_paths_in_sensitive_context_are_not_reported():
    for harmless in (
        "calculateAverageBalance", "customer-notification-service", "/usr/local/share/documentation",
        "src/main/java/com/company/InvoiceService", "responsibilities", "1234567890123456", "internationalization", "01" * 30 + "x",
    ):
        assert not [s for s in secrets.scan(f"The private value is {harmless} here.")[1] if s.kind == "novel"], harmless
