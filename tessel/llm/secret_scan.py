"""Secret scan with a random forest against false positives; DataFrame functions only.

Blocks of private keys, passwords within addresses, quoted values of assignments,
unquoted ones of at least 6 characters after a key word, and runs of key-like
characters (with a digit, a change from small to capital letters or 16 capitals in a
row) are candidates, the first that fits, however long.  A
forest on their length, character transitions, dictionary coverage, path and
neighbouring words, trained from labelled findings, tells secrets from look-alikes.

Defined results: null and empty texts have no findings; several findings of one
text give a row each, repeated rows their own; candidates don't overlap, of those
that begin at one place the first kind counts; a score equal to the threshold is a
secret; texts are scanned whole; a null path counts as empty; an empty table gives
an empty result.  Only the named columns are read.  Offsets
are code points of the original text.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands between parts of a text; where the text has it or the next one itself, both are written as pairs.
MARK, ESCAPE = "\x01", "\x02"
#: Private keys between their lines, and passwords of addresses (a look back of one character first, as longer ones cost time at every place).
KEY_BLOCK = r"""-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----\s*+(?:[A-Za-z-]{1,20}: [^\r\n]{0,100}\r?\n){0,6}+[A-Za-z0-9+/=\s\\]{16,}+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?"""
IN_ADDRESS = r"""(?<=:)(?<=[a-z]://[^\s/:@"']{0,64}:)[^\s/@"']{3,}+(?=@)"""
#: Quoted values of assignments, and key-like runs of 12 characters or more.
CANDIDATE = r"""(?:(?<=[=:]")|(?<=[=:] "))[^\s"]{8,}+(?=")|(?:(?<=[=:]')|(?<=[=:] '))[^\s']{8,}+(?=')|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{12})(?=[A-Za-z+/_-]*+[0-9]|[A-Za-z0-9+/_-]*?(?:[a-z][A-Z]|[A-Z]{16}))[A-Za-z0-9+/_-]++={0,2}"""
#: Values without quotes that are assigned to a key word, without the punctuation after them; Java only.
ASSIGNED = r"""(?<=[=:>\s])(?<=[=:]>?[ \t]{0,3})(?<=(?i:secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)[\w-]{0,20}["']?[ \t]{0,3}[=:]{1,2}>?[ \t]{0,3})[^\s"'=:>][^\s"']{4,}[^\s"'.,;)]"""
ANY = f"{KEY_BLOCK}|{IN_ADDRESS}|{ASSIGNED}|{CANDIDATE}"
NEIGHBOURS = 60
#: Parts of a text, gaps and candidates in turn, that hold so many characters: a candidate has 6 at least.
PARTS = 2 * NEIGHBOURS // 6
THRESHOLD = 0.5
#: Labelled findings that a fit looks at.
TRAIN_ROWS = 4000

# Words by which findings are judged.
KEY_WORDS = r"(?i)secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential"
INNOCENT_WORDS = r"(?i)example|placeholder|dummy|fake|sample|card|phone|order|invoice|isbn|iban|account|commit|checksum|sha1|sha256|md5|uuid|digest|build|version|page|tracking"
TEST_PATHS = r"(?i)test|example|sample|mock|fixture|demo"
DICTIONARY = "example password changeme secret token your insert replace here sample dummy test value default foobar admin user hello world placeholder null none true false todo name string key config local host index module version build image file page data info".split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


def features(candidate: str, path: str, before: str, after: str) -> dict[str, str]:
    """Features as SQL expressions over the SQL expressions of a candidate, its path and its neighbours."""
    quoted = lambda pattern: "r\"" + pattern + "\""
    share = lambda rest, of=candidate: f"(length({of}) - length({rest})) / greatest(length({of}), 1)"
    without = lambda pattern, of=candidate: f"regexp_replace({of}, {quoted(pattern)}, '')"
    flag = lambda cond: f"IF({cond}, 1D, 0D)"
    low = f"lower({candidate})"
    classes = f"translate({candidate}, '{string.ascii_uppercase + string.ascii_lowercase + string.digits}', '{'A' * 26 + 'a' * 26 + '9' * 10}')"
    return {
        "size": f"CAST(length({candidate}) AS DOUBLE)",
        "transitions": f"length(regexp_replace({classes}, {quoted(r'(.)\1+')}, '$1')) / greatest(length({candidate}), 1)",
        "digits": share(without("[0-9]")),
        "uppers": share(without("[A-Z]")),
        "distinct": f"size(array_distinct(split({candidate}, ''))) / greatest(length({candidate}), 1)",
        "vowels": share(without("[aeiouyAEIOUY]")),
        "shape_turns": f"length(regexp_replace({candidate}, {quoted(r'[a-z][A-Z]')}, 'x')) / greatest(length({candidate}), 1)",
        "bigrams": share(without("|".join(BIGRAMS), low), low),
        "words": share(without("|".join(DICTIONARY), low), low),
        "path_test": flag(f"{path} RLIKE {quoted(TEST_PATHS)}"),
        "key_before": flag(f"{before} RLIKE {quoted(KEY_WORDS)}"),
        "assigned": flag(f"{before} RLIKE {quoted(r'(?:=|:|=>)\s*[\x22\x27]?$')}"),
        "quoted": flag(f"{before} RLIKE {quoted(r'[\x22\x27]$')} AND {after} RLIKE {quoted(r'^[\x22\x27]')}"),
        "innocent_near": flag(f"concat({before}, ' ', {after}) RLIKE {quoted(INNOCENT_WORDS)}"),
        "key_block": flag(f"{candidate} RLIKE {quoted('^-----BEGIN ')}"),
        "in_address": flag(f"{before} RLIKE {quoted(r'://[^\s/:@]{0,64}:$')} AND {after} RLIKE {quoted('^@')}"),
        "known_prefix": flag(f"{candidate} RLIKE {quoted(r'^(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20}|sk_(?:live|test)_|xox[abprs]-|AIza[0-9A-Za-z_-]{30}|eyJ[A-Za-z0-9_-]{8})')}"),
        "only_digits": flag(f"{candidate} RLIKE {quoted('^[0-9_+/=-]+$')}"),
    }


def labelled_findings(n: int = 1500, seed: int = 11) -> list[dict]:
    """Findings of known kind, made from a seed: keys and passwords as they are assigned, and what resembles them."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    hexes, alnum, letters = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters
    word = lambda a=3, b=9: "".join(rng.choice(BIGRAMS) for _ in range(rng.randint(a, b) // 2 + 1))
    prose = lambda: " ".join(pick(string.ascii_lowercase, 2, 9) for _ in range(rng.randint(0, 8)))
    sign = lambda: rng.choice([" = ", "=", ": ", ":"])
    out = []
    for k in range(n):
        q = rng.choice(['"', '"', "'", ""])
        name = rng.choice(["token", "secret", "password", "api_key", "access_key", "auth_token", "TOKEN", "client_secret", "credential"])
        value = rng.choice([lambda: pick(hexes, 32, 64), lambda: pick(alnum, 20, 48), lambda: pick(alnum + "+/", 30, 60) + "==", lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "AKIA" + pick(string.ascii_uppercase, 16, 16), lambda: pick(letters, 24, 60), lambda: pick(alnum + "!$%&*?", 12, 300), lambda: "ghp_" + pick(alnum, 36, 36), lambda: "sk_live_" + pick(alnum, 24, 24), lambda: pick(hexes.upper(), 40, 40)])()
        bare = value[:4] in ("AKIA", "ghp_", "sk_l") and rng.random() < 0.4
        before = f"{prose()} " if bare else f"{prose()} {name}{sign()}{q}"
        after = ("" if bare else q) + rng.choice([" ", "!! ", "\n"]) + prose()
        if k % 9 == 0:  # whole keys and passwords of addresses
            block = "\n".join(pick(alnum + "+/", 64, 64) for _ in range(rng.randint(1, 12)))
            value, before, after = f"-----BEGIN {rng.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----\n{block}\n", f"{prose()}\n", f"-----END PRIVATE KEY-----\n{prose()}"
        elif k % 9 == 1:
            value, before, after = pick(alnum, 6, 24), f"{prose()} {rng.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{word()}:", f"@{word()}.{word()}/{word()}"
        elif k % 9 == 2:  # as people choose them, after a key word
            value, before, after = word() + pick(string.digits, 1, 4), f"{prose()} {rng.choice(['password', 'passwd', 'pwd'])}{sign()}", rng.choice(["\n", " "]) + prose()
        out.append({"candidate": value, "path": rng.choice(["src/app.py", "config.yml", "a3", "b17", "deploy/env"]), "before": before[-NEIGHBOURS:], "after": after[:NEIGHBOURS], "label": 1})
        kind = k % 12
        key, innocent = f"{prose()} {name}{sign()}{q}", rng.choice(["commit ", "sha256 ", "checksum: ", "md5 = ", "digest=", "uuid ", "build "])
        words = rng.sample(DICTIONARY, 3)
        value, before, path = [
            (pick(string.digits, 12, 19), prose() + rng.choice([" ", " card ", " order ", " phone +"]), "b5"),
            (pick(hexes, 32, 64), f"{prose()} {innocent}", "CHANGELOG"),
            (rng.choice(["-", "_"]).join(words) + rng.choice(["1", "123", "_2"]), key, "README"),
            (rng.choice(["x" * 20 + "1", "0" * 24, "1234567890abcdef", "YOUR_API_KEY_HERE_123", "changeme12345"]), key, "docs/example.md"),
            (pick(hexes, 32, 40), key, rng.choice(["tests/fixtures/a.py", "examples/demo.py", "mock/server.py"])),
            ("/".join(pick(string.ascii_lowercase, 3, 9) for _ in range(4)) + pick(string.digits, 1, 2), prose() + " ", "c9"),
            ("".join(word().capitalize() for _ in range(4)), f"{prose()} ", "src/main.java"),
            (word(18, 40) + rng.choice(["", "-" + word()]) + word().capitalize(), f"{prose()} ", "d4"),
            (word(18, 40).upper(), f"{prose()} ", "e2"),
            (f"{word()}-{word()}-20{pick(string.digits, 2, 2)}-{pick(string.digits, 2, 2)}-{pick(string.digits, 2, 2)}", f"{prose()} ", "posts"),
            (f"{word()}_{word()}_{word()}_{pick(string.digits, 1, 3)}", rng.choice([f"{prose()} ", f"{prose()} name = ", f"{prose()} id: "]), "f1"),
            (rng.choice(["os.environ", "getenv", "config.get", "settings."]) + word() + "()" + rng.choice(["", ".strip()"]), key, "src/app.py"),
        ][kind]
        out.append({"candidate": value, "path": path, "before": before[-NEIGHBOURS:], "after": (rng.choice([" ", "\n", ". "]) + prose())[:NEIGHBOURS], "label": 0})
    return out


def findings_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    kind = "array<struct<candidate:string,path:string,before:string,after:string,label:int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


Tree = float | tuple[int, float, "Tree", "Tree"]


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """A tree of nested ``(feature, threshold, at most, above)``; each split tries a part of the features and least mixes the labels."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) - 1e-9, -1, 0.0)
    for k in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 34)[1:-1]))
        for t in (edges[:-1] + edges[1:]) / 2 if len(edges) > 1 else edges:
            under = x[:, k] <= t
            n = int(under.sum())
            if 0 < n < len(y):
                p, q = y[under].mean(), y[~under].mean()
                mixed = (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if mixed < best[0]:
                    best = (mixed, int(k), float(t))
    if best[1] < 0:
        return share
    under = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[under], y[under], depth - 1, rng), grow(x[~under], y[~under], depth - 1, rng)


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 5) -> list[Tree]:
    """A forest from labelled findings (``candidate``, ``path``, ``before``, ``after``, ``label``), of which it takes at most ``TRAIN_ROWS``.

    Features are computed as they are for scoring; the driver gets no more than so many rows of numbers.
    """
    text = lambda c: f"coalesce({c}, '')"
    rows = findings.orderBy(F.xxhash64("candidate", "before", "after")).limit(TRAIN_ROWS)
    got = rows.selectExpr("CAST(label AS DOUBLE) AS label", *[f"{e} AS {k}" for k, e in features(*map(text, ("candidate", "path", "before", "after"))).items()]).collect()
    table = np.array([tuple(r) for r in got], np.float64)
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        own = rng.integers(len(table), size=len(table))
        forest.append(grow(table[own, 1:], table[own, 0], depth, rng))
    return forest


def tree_value(tree: Tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_sql(tree: Tree, names: list[str]) -> str:
    """A tree as nested conditions on the fields of a struct ``f``."""
    if not isinstance(tree, tuple):
        return f"{tree:.9f}D"
    return f"IF(f.{names[tree[0]]} <= {tree[1]:.17g}D, {tree_sql(tree[2], names)}, {tree_sql(tree[3], names)})"


def score(forest: list[Tree], candidate: str, path: str, before: str, after: str) -> str:
    """Likelihood of a secret in SQL: the mean of the trees, over features that are computed once."""
    made = features(candidate, path, before, after)
    struct = ", ".join(f"'{k}', {e}" for k, e in made.items())
    total = " + ".join(tree_sql(t, list(made)) for t in forest)
    return f"element_at(transform(array(named_struct({struct})), f -> ROUND(({total}) / {len(forest)}, 6)), 1)"


def taking_turns(text: Column) -> Column:
    """Text and candidates in turn, from text to text; joined they are the text."""
    own = text.contains(MARK) | text.contains(ESCAPE)
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "\x04")), F.lit(MARK), F.lit(ESCAPE + "\x03"))
    back = lambda x: F.replace(F.replace(x, F.lit(ESCAPE + "\x03"), F.lit(MARK)), F.lit(ESCAPE + "\x04"), F.lit(ESCAPE))
    split = lambda t: F.split(F.regexp_replace(t, f"({ANY})", f"{MARK}$1{MARK}"), MARK)
    return F.when(own, F.transform(split(escaped), back)).otherwise(split(text))


def with_edges(parts: DataFrame) -> DataFrame:
    """``parts`` with the first and last characters of each part."""
    return parts.select("*", F.expr(f"transform(p, x -> left(x, {NEIGHBOURS}))").alias("firsts"), F.expr(f"transform(p, x -> right(x, {NEIGHBOURS}))").alias("lasts"))


#: What stands in the text before and after the part ``k``, other candidates included.
BEFORE = f"right(array_join(slice(lasts, greatest(k - {PARTS}, 0) + 1, least(k, {PARTS})), ''), {NEIGHBOURS})"
AFTER = f"left(array_join(slice(firsts, k + 2, {PARTS}), ''), {NEIGHBOURS})"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``__id``, ``__row``, ``start``, ``end``, ``candidate``, ``path``, ``before``, ``after`` of every candidate."""
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), path.alias("path"), F.col(f"`{text_col}`").alias("t")).filter(F.col("t").rlike(ANY))
    parts = with_edges(rows.select("__id", "path", F.monotonically_increasing_id().alias("__row"), taking_turns(F.col("t")).alias("p")))
    found = F.expr(f"transform(sequence(1, size(p) - 1, 2), k -> named_struct('k', k, 'gap', length(get(p, k - 1)), 'candidate', get(p, k), 'before', {BEFORE}, 'after', {AFTER}))")
    each = parts.select("__id", "__row", "path", F.explode(found).alias("s")).select("__id", "__row", "path", "s.*")
    # a candidate knows the gap before it, so its place is a sum over its text's candidates
    upto = F.sum(F.col("gap") + F.length("candidate")).over(Window.partitionBy("__row").orderBy("k"))
    return each.withColumn("end", upto.cast("int")).withColumn("start", (F.col("end") - F.length("candidate")).cast("int")).drop("gap", "k")


def own_forest(spark: SparkSession) -> list[Tree]:
    return train(findings_table(spark, labelled_findings()))


def scan(df: DataFrame, forest: list[Tree] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``__id``, ``start``, ``end``, ``candidate``, ``score``, ``is_secret`` of every candidate."""
    found = candidates(df, id_col, text_col, path_col)
    likely = F.expr(score(forest or own_forest(df.sparkSession), "candidate", "path", "before", "after"))
    return found.select("__id", "start", "end", "candidate", likely.alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def redact(df: DataFrame, forest: list[Tree] | None = None, text_col: str = "text", path_col: str | None = "source", mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with each secret replaced by ``mask``: row by row, without a shuffle."""
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.col(f"`{text_col}`")
    rows = df.select(F.struct("*").alias("row"), path.alias("path"), F.lit(mask).alias("mask"), F.when(text.rlike(ANY), taking_turns(text)).alias("p"))
    rows = with_edges(rows)
    judged = score(forest or own_forest(df.sparkSession), "x", "path", "n.before", "n.after")
    likely = f"element_at(transform(array(named_struct('before', {BEFORE}, 'after', {AFTER})), n -> {judged}), 1)"
    masked = F.expr(f"array_join(transform(p, (x, k) -> IF(k % 2 = 1 AND {likely} >= {threshold}, mask, x)), '')")
    new = F.when(F.col("p").isNull(), F.col(f"row.`{text_col}`")).otherwise(masked)
    return rows.select(F.col("row").withField(f"`{text_col}`", new).alias("row")).select("row.*")
