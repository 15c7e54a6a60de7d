"""Secret scan: base spans against the plain rules, lexed spans, odd rows."""

import hashlib
import os
import re

from touchline.llm import secrets

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def plain_base(text):
    """The contract's rules with a match per kind, failing ones dropped afterwards."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_table_equals_plain_rules(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = secrets.op10_assignment_secrets(spark, SF).collect()
    assert len(out) == len(texts)
    names = ["assign", "access", "hex"]
    for r in out:
        want = plain_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        kept = [x for x in r.spans.split(",") if x and not x.startswith("lexed")]
        assert ",".join(kept) == said


def test_base_rules_at_their_edges():
    for text in (
        "password=abc password=token:abcdef PASSWORD : 'abcdef", "token=secret=abcdefg", "api_key=Abc.def-g api-key=abcdefgh apikey: x", "AKIA" + "A" * 15,
        "AKIA" + "B" * 16 + "c", "AKIAAKIA" + "1" * 20, "0" * 23, "g" + "a" * 24 + "F" + "b" * 30, "ſecret=abcdefgh toKen=abcdefgh",
        "secret='ſſſſſſſ'", "passwd\"  =  \"abcdef", "token\n=abcdef", "🙂password=ééabcdef secret=abcdef🙂",
    ):
        want = [(s, e, ["assign", "access", "hex"][k]) for s, k, e in plain_base(text)]
        assert sorted(secrets.base_spans(text), key=lambda x: (x[0], secrets.KINDS[x[2]])) == want, text


def said(text):
    return {text[s:e] for s, e, _ in secrets.lexed_spans(text)}


def test_lexed_assignments():
    assert said('db_pwd = "hunter2-Zx9"') == {"hunter2-Zx9"}
    assert said('{"privateKey": "MIIEvQ1BADx9"}') == {"MIIEvQ1BADx9"}
    assert said("aws:\n  access-key: aZ3dF6hJ9kLm\n  region: eu-west-1") == {"aZ3dF6hJ9kLm"}
    assert said("headers['auth_token'] = 'Q1w2E3r4T5y6'") == {"Q1w2E3r4T5y6"}
    assert said("k = 'Q1w2E3r4T5y6'\nother = 3\nclient_secret = k") == {"Q1w2E3r4T5y6"}
    assert said("a = 'Q1w2E3'\nb = 'r4T5y6'\napiToken = a + b + 'zz9'") == {"Q1w2E3", "r4T5y6", "zz9"}
    assert said("pass_phrase := `correct9Horse`\nCREDENTIALS => 'u5er:Passw0rd'") == {"u5er:Passw0rd"}
    for clean in ("max_token_count = 'abcdef123456'", "password = 'changeme'", "secret: ${VAULT_PATH}", "token = None", "key = 'Q1w2E3r4T5y6'", "The password: it was a long story", "x == 'Q1w2E3r4'"):
        assert not said(clean), clean


def test_lexed_syntaxes():
    lit = "Zx81kQ77ab"
    for text in (
        'password: str = "%s"', 'const apiKey: string = "%s";', "db_pwd = (\n    '%s'\n)", 'db_pwd = """%s"""', "db_pwd = r'%s'", "db_pwd:\n  %s\nother: 1", "private_key: |\n  %s\nnext: 2",
        'pwd = base\nbase = "%s"', "export DB_PWD=$BASE\nBASE=%s", 'db_pwd = f("%s")', 'os.getenv("db_pwd", "%s")', "<pwd>%s</pwd>", '#define DB_PWD "%s"', "ENV DB_PWD %s",
        'var pwd string = "%s"', 'String dbPwd = "%s";', '<add key="ApiSecret" value="%s"/>', '<entry key="db_pwd">%s</entry>', 'connect(user="me", pwd="%s")', 'conn = "Server=a;Pwd=%s;Db=b"',
        "db_pwd =\n    '%s'", "db_pwd = `%s`", 'let auth_token: Option<&str> = Some("%s");', 'db_pwd := r#"%s"#', "DB_PWD=$(cat <<END\n%s\nEND\n)", "client_secret = a.b\nx = 1\na.b = c\nc = '%s'",
        'db_pwd = \\\n  "%s"', "cfg['db_pwd'] = decode('%s', 'utf8')", "{'db': {'pwd': '%s'}}", "it's the db_pwd = '%s' that isn't", 'db_pwd = prefix + "%s"',
    ):
        assert lit in said(text % lit), text
    assert said('db_pwd = ("Zx81kQ"\n          "77abXy")') == {"Zx81kQ", "77abXy"}
    assert said('api_token = "Zx81kQ" +\n    "77abXy9"') == {"Zx81kQ", "77abXy9"}
    assert said("private_key: >-\n  Zx81kQ77ab\n  Yw92lR88bc\nplain: Zx81kQ77ab1") == {"Zx81kQ77ab", "Yw92lR88bc"}
    for clean in (
        "password: StringProperty", "interface A { apiKey: CredentialProvider; token: string }", "password: str = None", "pwd = getpass(prompt='Zx81kQ77ab')", "a = b\nb = a\npwd = a",
        "The auth token: Something\nElse follows here", "for token in tokens:\n    count1234567 = 3", "pwd = other\nOther = 'Zx81kQ77ab'", "token == 'Zx81kQ77ab'", "<b>token</b> <i>Zx81kQ77ab</i>", "db_pwd = x(\nname='Zx81kQ77ab')",
    ):
        assert not said(clean), (clean, said(clean))


def test_sums_of_any_number_of_parts():
    pieces = [f"{i % 10}{'aZqK'[i % 4]}" for i in range(150)]
    assert said("db_pwd = " + " + ".join(f"'{p}'" for p in pieces)) == set(pieces)
    chain = "".join(f"v{i} = v{i + 1} + '{p}'\n" for i, p in enumerate(pieces)) + "v150 = 'Zx'\ndb_pwd = v0"
    assert said(chain) == {*pieces, "Zx"}
    many = "".join(f"part = '{p}'\n" for p in pieces) + "db_pwd = part\napi_token = part + 'y7'"
    assert said(many) == {*pieces, "y7"}


def test_lexing_takes_linear_time():
    import time

    for piece in ("pwd='", 'pwd="""', "pwd=(", "pwd=r#\"", "pwd: |\n", "pwd=<<A\n", "a=b+", "pwd=f(", "<pwd>", "pwd: x", "token:\n", "`", '["pwd", ', "a = pwd\npwd = a\n", "password " * 3, "pwd = a + "):
        begin = time.perf_counter()
        secrets.lexed_spans(piece * (200_000 // len(piece)))
        once = time.perf_counter() - begin
        assert once < 20, (piece, once)


def test_strings_equal_the_tokeniser_of_the_language():
    """Every literal that Python's own tokeniser sees assigned to a sensitive name is found, and nothing around it."""
    import ast
    import io
    import random
    import tokenize

    rnd = random.Random(6)
    for _ in range(200):
        body = "".join(rnd.choice("abcXYZ0189-_/") for _ in range(14)) + "Q7z"
        quote = rnd.choice(["'", '"', '"' * 3, "'" * 3])
        name = rnd.choice(["db_pwd", "api_key", "self.secret"]) + rnd.choice([": str", "", ": Optional[str]"])
        text = f"x{rnd.randrange(9)} = 1\n{name} = {rnd.choice(['', '(', 'f(', 'f(1, '])}{rnd.choice(['', 'r', 'b'])}{quote}{body}{quote}"
        text += ")" if "(" in text else ""
        strings = [ast.literal_eval(t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.STRING]
        assert [s.decode() if isinstance(s, bytes) else s for s in strings] == [body]
        assert said(text) == {body}, text


def test_odd_rows(spark):
    long_text = "a" * 300_000 + "=" + "b" * 300_000 + " token" * 50_000 + " secret='Zx9Zx9Zx9Qq1'"
    rows = [(1, None, "x"), (2, "", "y"), (3, long_text, None), (None, "token=abcdef", "z"), (5, "token=abcdef", "z"), (5, "token=abcdef", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secrets.span_digest(secrets.find_secrets(docs)).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == 6 and by_id[1].spans == by_id[2].spans == "" and by_id[5].spans == "assign:0:12" and by_id[None].n_assign == 1
    assert by_id[3].n_assign == 1 and "lexed" in by_id[3].spans
    assert secrets.find_secrets(docs.where("doc_id < 0")).count() == 0
