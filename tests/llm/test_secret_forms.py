"""Forms of name-literal pairs in sources and configurations, against a parser of one of the languages and by example."""

import ast
import random
import string
import time

import pytest

from ebbmark.llm import secrets

K = "Zx9kQ27vvT81mPq4"
R = K[::-1]


def found(text):
    return [text[a:b] for a, b, _ in secrets.literals(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        (f'encryption_key: str = "{K}"', [K]),
        (f'signingKey: string = "{K}"', [K]),
        (f"let signing_key: &'static str = \"{K}\";", [K]),
        (f"const privateKey = `{K}`", [K]),
        (f'private_key = b"{K}"', [K]),
        (f'auth_key = ("{K}")', [K]),
        (f'auth_keys = [\n  "{K}",\n  "{R}"]', [K, R]),
        (f'const char signing_key[] = {{"{K}"}};', [K]),
        (f'private_key = """{K}"""', [K]),
        (f"<privateKey>{K}</privateKey>", [K]),
        (f"<a:privateKey>\n {K}\n</a:privateKey>", [K]),
        (f"<name>{K}</name>", []),
        (f"private_key: |\n  {K}\n  {R}\nnext: x", [K, R]),
        (f"- private_key: |\n    {K}\n  other: {R}", [K]),
        (f"define('AUTH_KEY', '{K}');", [K]),
        (f"define('TITLE_OF', '{K}');", []),
        (f'auth_key = "{K[:8]}" + \n   "{K[8:]}"', [K[:8], K[8:]]),
        (f'auth_key = "{K[:8]}" \\\n  "{K[8:]}"', [K[:8], K[8:]]),
        ('passphrase = "correct horse battery staple"', ["correct horse battery staple"]),
        ('auth_note = "please ask the owner first"', []),
        (f'auth_key = os.getenv("AUTH_KEY", "{K}")', [K]),
        ('auth_key = os.getenv("AUTH_KEY")', []),
        ("auth_key = load(path)", []),
        (f'client.setCredential("{K}")', [K]),
        (f'x = get_credential("{K}")', []),
        (f'"auth": {{"user": "{R}", "privateKey": "{K}"}}', [K]),
        ('"""' + f'\nprivate_key = "{K}"', [K]),
    ],
)
def test_forms(text, expected):
    assert found(text) == expected


def _source(rng):
    """A module of assignments; names are sensitive or not, values in every form that Python has for them."""
    lines = []
    for i in range(40):
        name = rng.choice(["auth_key", "signingKey", "title", "colour_name", "private_key", "credential"]) + f"_{i}"
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice([4, 20, 24]))) + "7a"
        quote = rng.choice(["'", '"', '"""'])
        lit = quote + value + quote
        form = rng.choice(["{n} = {v}", "{n}: str = {v}", "{n} = ({v})", "{n} = [{v}, {v2}]", "{n} = call({v})", "f({n}={v})", "d['{n}'] = {v}", "{n} = {v} # {n}"])
        lines.append(form.format(n=name, v=lit, v2=repr(value[::-1])))
    return "\n".join(lines) + "\n"


def _assigned(source):
    """Texts of the literals that a parser sees under sensitive names."""
    out = []

    def of(name, value):
        for c in ast.walk(value):
            if isinstance(c, ast.Constant) and isinstance(c.value, str) and secrets.name_score(name) * secrets.literal_score(c.value) >= secrets.SCORE:
                out.append(c.value)

    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Assign):
            target = node.targets[0]
            of(target.id if isinstance(target, ast.Name) else target.slice.value, node.value)
        elif isinstance(node, ast.AnnAssign):
            of(node.target.id, node.value)
        elif isinstance(node, ast.keyword):
            of(node.arg, node.value)
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_sources_against_a_parser(seed):
    source = _source(random.Random(seed))
    assert sorted(found(source)) == _assigned(source)


@pytest.mark.parametrize("part", ['key = """', "key = `", '"abcdefghij", ', 'a("x", ', "a=('\"", " b: |\n", "<a>", "a: ", 'key="""\\', 'key="a"+\n', "key = [\n"])
def test_long_texts_take_linear_time(part):
    at = time.time()
    secrets.literals("keys = [" + part * (1_000_000 // len(part)))
    assert time.time() - at < 20
