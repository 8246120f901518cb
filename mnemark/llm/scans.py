"""Noise in text from scanned pages: furniture lines, words broken over lines, misread words.

A line-pair classifier, fitted to pages made of the texts' own words, tells running headers from body lines; page numbers are told by their
form, broken words by the lines' ends. Misread words get candidates
through an inverted join on the q-grams of look-alike forms; boosted trees, trained on corruptions of the corpus's own frequent words,
choose the replacement or none.
"""

from __future__ import annotations

import random
import re
import textwrap
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from mnemark.session import broadcast_if_small, cut

#: A word that others may be misread forms of stands in at least so many documents, however many there are.
GOOD_DOCS = 3
#: Candidates for a form are at least so many times as frequent.
RARER = 5
#: Least share of the q-grams of the longer look-alike form that both forms have.
SHARED_GRAMS = 0.5
#: Frequent words whose corruptions train the ranking, and corruptions of each.
TRAIN_WORDS, TRAIN_FORMS = 600, 3
SURE = 0.5
MAPPING_BROADCAST = 300_000
# Letters that scanned pages take for others. Longer ones first.
CONFUSED = [("rn", "m"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("d", "cl"), ("e", "c"), ("c", "e"), ("a", "o"), ("h", "b"), ("t", "f"), ("i", "l"), ("l", "1"), ("o", "0"), ("b", "6"), ("g", "q"), ("1", "l"), ("0", "O"), ("s", "5"), ("l", "I"), ("n", "u"), ("fi", "ﬁ"), ("fl", "ﬂ")]
FEATURES = ["edits", "folded_edits", "longer", "shared", "rarer", "same_first", "size"]

TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
HYPHENS = "-‐­¬"
HYPHEN = re.compile(r"([^\W_]+(?:['’\-][^\W_]+)*)[-‐­¬]$")
FIRST = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
NUMBER = re.compile(r"[\[({\-–—\s.|]*(?:(?:page|pag\.?|pg\.?|p\.|seite|s\.|página|folio)\s*)?(?:[0-9lIOo]{1,4}|[ivxl]{1,6}|[IVXL]{1,6})(?:\s*(?:of|/|von|de|sur)\s*[0-9lIOo]{1,4})?[\])}\-–—\s.|]*", re.I)
LETTERS_ONLY = re.compile(r"[xX]{0,3}(?:[iI][xXvV]|[vV]?[iI]{0,3})|[lI]{1,2}|(?:page|p\.) .+", re.I)
PLAIN = re.compile(r"\d{1,4}[.)]?")
TITLE = re.compile(r"[\"“”„«»]([^\"“”„«»]{3,200})[\"“”„«»]")
DECORATION = "—–-~*=|_· \t[]()"
CAPITALS, MARK = "0158l", "^"  # what a misread capital looks like
LOOKALIKE = str.maketrans("0156", "olsb")


def _bare(line: str) -> str:
    """A line without its decoration, page number and look-alike digits."""
    s = re.sub(r"^\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*$", "", line.strip(DECORATION)).strip(DECORATION)
    return s.translate(LOOKALIKE).casefold()


#: What a line's pairs with its neighbours show, in the order of line_pairs.
PAIR_FEATURES = ["titled", "decorated", "indented", "again", "short_open", "breaks_before", "runs_on", "after_lower", "closed", "lower", "long", "hyphen"]


def page_numbers(stripped: list[str]) -> list[int]:
    """Lines with only a page number, unless they are those of a numbered list: counted from one, one whole sentence under each."""
    numbers = [i for i, s in enumerate(stripped) if s and NUMBER.fullmatch(s) and (any(c.isdigit() for c in s) or not s[0].isalpha() or LETTERS_ONLY.fullmatch(s))]
    plain = [i for i in numbers if PLAIN.fullmatch(stripped[i])]
    if plain and plain == numbers and int(re.sub(r"\D", "", stripped[plain[0]])) == 1:
        ends = [*plain[1:], len(stripped)]
        items = [[s for s in stripped[a + 1 : b] if s] for a, b in zip(plain, ends)]
        if all(len(x) == 1 and x[0][-1:] in ".!?…\"'" for x in items[:-1]) and items[-1] and items[-1][0][-1:] in ".!?…\"'":
            return []
    return numbers


def line_pairs(lines: list[str], breaks: set[int], title: str) -> tuple[list[int], list[int], np.ndarray]:
    """Lines with page numbers, lines that may be running headers, and of each of the latter PAIR_FEATURES: what it looks like beside the
    lines before and after it, and whether it comes again or is the title."""
    stripped = [x.strip() for x in lines]
    numbers = page_numbers(stripped)
    other = set(numbers)
    body = [i for i, s in enumerate(stripped) if s and i not in other]
    sizes = sorted(len(stripped[i]) for i in body)
    width = sizes[int(len(sizes) * 0.85)] if sizes else 0
    bare = [_bare(x) for x in lines]
    again = {b for b, n in Counter(bare).items() if b and n > 1}
    name = title.translate(LOOKALIKE).casefold()
    name_words = set(name.split())
    # In wrapped text a short line ends a paragraph. Where one runs on in lower case, the lines aren't those of a page.
    ragged = any(s and s[0].islower() and s[-1] not in ".!?:;,…\"'”)" + HYPHENS and len(s) < 0.72 * width for i, s in enumerate(stripped[:-1]) if i not in other)
    at, rows = [], []
    for n, i in enumerate(body):
        s = stripped[i]
        words = TOKEN.findall(s)
        after = stripped[body[n + 1]] if n + 1 < len(body) else ""
        # The end of a sentence, a word that goes on in the next line, and lines without words are no headers.
        if (s[-1] == "." and s[0].islower()) or (s[-1] in HYPHENS and after[:1].islower()) or not any(len(w) > 1 and not w.isdigit() for w in words):
            continue
        closed = s[-1] in ".!?:;,…\"'”)"
        titled = bool(name) and (bare[i] == name or (not closed and abs(len(bare[i]) - len(name)) < 8 and len(name_words.intersection(bare[i].split())) > 1 and SequenceMatcher(None, bare[i], name, autojunk=False).ratio() > 0.85))
        before = stripped[body[n - 1]] if n else ""
        at.append(i)
        rows.append((titled, s[0] in "—–-~*=|" and s[-1] in "—–-~*=|", lines[i][:3].isspace() and len(lines[i]) > 3, bare[i] in again and len(words) <= 9, not closed and not ragged and len(s) < 0.72 * width, i in breaks or not i or not stripped[i - 1], bool(before) and before[-1] not in ".!?…\"'”", after[:1].islower(), closed, s[0].islower(), len(words) > 9, s[-1] in HYPHENS))
    return numbers, at, np.array(rows, dtype=np.float64).reshape(len(at), len(PAIR_FEATURES))


def furniture(lines: list[str], breaks: set[int], title: str, weights: np.ndarray) -> list[str | None]:
    """For each line `header`, `page_number` or None, by the fitted weights of PAIR_FEATURES and the last one, which stands alone."""
    kinds: list[str | None] = [None] * len(lines)
    numbers, at, x = line_pairs(lines, breaks, title)
    for i in numbers:
        kinds[i] = "page_number"
    for i, score in zip(at, x @ weights[:-1] + weights[-1]):
        if score > 0:
            kinds[i] = "header"
    return kinds


#: Scanned texts whose words make the pages from which the line-pair classifier learns, and pages made of each.
TRAIN_TEXTS, TRAIN_PAGES = 300, 2
#: Least characters of such a page: short texts are filled up with the next ones.
PAGE_CHARS = 1500
MARKS = ["— {} —", "- {} -", "* {} *", "= {} =", "| {} |", "~ {} ~"]


def hyphenated(lines: list[str], how: random.Random) -> list[str]:
    """Lines of a paragraph, of which one in four ends in a part of the next one's first word."""
    out = list(lines)
    for n in range(len(out) - 1):
        word, _, rest = out[n + 1].partition(" ")
        if len(word) > 4 and word.isalpha() and how.random() < 0.25:
            k = how.randint(2, len(word) - 2)
            out[n], out[n + 1] = f"{out[n]} {word[:k]}-", f"{word[k:]} {rest}".strip()
    return out


def made_page(text: str, how: random.Random) -> tuple[list[str], set[int], str, list[int]]:
    """A page made of a text's words, set in lines of one width, with running headers planted between them: its lines, those that begin
    a page, its title, and the lines that are headers."""
    first, _, rest = text.partition("\n")
    words = rest.split()
    m = TITLE.search(first)
    title = m[1] if m else " ".join(w.capitalize() for w in how.sample(words, min(len(words), 3)))
    width, lines, breaks, headers = how.randint(38, 88), [], set(), []
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", " ".join(words)) if x]
    while sentences:
        now, sentences = sentences[: (k := how.randint(2, 6))], sentences[k:]
        paragraph = hyphenated(textwrap.wrap(" ".join(now), width, break_long_words=False, break_on_hyphens=False), how)
        if paragraph and how.random() < 0.7:
            # A page ends within the paragraph.
            k = how.randrange(len(paragraph))
            kind = how.random()
            name = title if kind < 0.5 else " ".join(w.strip(".,!?").capitalize() for w in how.sample(words, min(len(words), how.randint(2, 4))))
            name = corrupt(name, how) if how.random() < 0.3 else name
            name = how.choice([name, name, name.upper(), how.choice(MARKS).format(name), " " * how.randint(4, 20) + name])
            lines += paragraph[:k] + [""] * how.choice((0, 1))
            if how.random() < 0.4:
                breaks.add(len(lines))
            headers.append(len(lines))
            lines += [name] + [str(how.randint(2, 90))] * (how.random() < 0.4) + [""] * how.choice((0, 1)) + paragraph[k:]
        else:
            lines += paragraph
        lines += [""] * how.choice((0, 1, 1))
    return lines, breaks, title if m else "", headers


def line_weights(df: DataFrame, text: str, seed: int = 3) -> np.ndarray:
    """Weights of PAIR_FEATURES by logistic regression over the lines of pages made of TRAIN_TEXTS texts (those of the smallest hashes);
    without any text no line is a header."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, whole = [], b["text"].tolist()
            rests = [t.partition("\n")[2] for t in whole]
            for n, t in enumerate(whole):
                how, k = random.Random(f"{seed}{n}"), n
                while len(t) < PAGE_CHARS:
                    k += 1
                    t += "\n" + rests[k % len(rests)]
                for _ in range(TRAIN_PAGES):
                    lines, breaks, title, headers = made_page(t, how)
                    _, at, x = line_pairs(lines, breaks, title)
                    out += [(float(i in headers), row.tolist()) for i, row in zip(at, x)]
            yield pd.DataFrame(out, columns=["label", "x"])

    texts = df.select(F.col(text).alias("text")).filter(F.col("text").rlike(r"\n.*\S\s+\S")).distinct().orderBy(F.xxhash64("text"), "text").limit(TRAIN_TEXTS)
    made = cut(texts.mapInPandas(pages, "label double, x array<double>").select("label", array_to_vector("x").alias("features")))
    if made.select("label").distinct().count() < 2:
        return np.append(np.zeros(len(PAIR_FEATURES)), -1.0)
    fitted = LogisticRegression(maxIter=50, regParam=1e-3).fit(made)
    return np.append(fitted.coefficients.toArray(), fitted.intercept)


def layout(text: str, weights: np.ndarray) -> tuple[str, list[str], set[int], list[str | None]]:
    """First line, the other lines, those of them that begin a page, and the kind of each (see furniture)."""
    first, _, rest = text.partition("\n")
    lines, breaks = [], set()
    for k, page in enumerate(rest.split("\x0c")):
        if k:
            breaks.add(len(lines))
        lines += page.split("\n")
    m = TITLE.search(first)
    return first, lines, breaks, furniture(lines, breaks, m[1] if m else "", weights)


def walk(body: list[str]) -> Iterator[tuple[int, list[tuple[int, int, str]], re.Match | None, re.Match | None, bool]]:
    """For each body line where its own text begins, its words (start, end, word), the hyphenated word that ends it with the first
    word of the next line, and whether the two are one broken word."""
    skip = 0
    for n, line in enumerate(body):
        h = HYPHEN.search(line) if n + 1 < len(body) and line[-1] in HYPHENS else None
        b = FIRST.match(body[n + 1]) if h else None
        end = h.start() if b else len(line)
        words = []
        for m in TOKEN.finditer(line, skip, end):
            w = m[0]
            if w[0] in CAPITALS and w[1:].islower():
                # Misread capitals are told by their place: a mark says that a sentence begins here.
                ahead = line[: m.start()].rstrip() or (body[n - 1] if n else ".")
                w = MARK + w if ahead[-1] in ".!?" else w
            words.append((m.start(), m.end(), w))
        broken = bool(b and (b[0][0].islower() or not b[0][0].isalpha() or h[1][-1].isupper()))
        yield skip, words, h if b else None, b, broken
        skip = b.end() if broken else 0


def parse(text: str, weights: np.ndarray) -> tuple[list[str], list[str], list[tuple[str, str]], list[str], list[str]]:
    """Headers, page numbers, broken words as (before, after), distinct words of the running text, and its body lines."""
    _, lines, _, kinds = layout(text, weights)
    headers = [x.strip() for x, k in zip(lines, kinds) if k == "header"]
    pages = [x.strip() for x, k in zip(lines, kinds) if k == "page_number"]
    body = [x.strip() for x, k in zip(lines, kinds) if not k and x.strip()]
    broken, words = [], set()
    for _, found, h, b, joined in walk(body):
        words.update(w for _, _, w in found)
        if joined:
            broken.append((h[1], b[0]))
    return sorted(set(headers)), sorted(set(pages)), broken, sorted(words), body


def repair(text: str, fixes: dict[str, str], weights: np.ndarray) -> str:
    """The text without furniture, its broken words joined, its misread words replaced and the lines of each paragraph on one line,
    with an empty line between paragraphs; the first line stays as it is.

    fixes: of a misread word (as walk has it) its word, of the parts of a broken word ("a\nb") the whole one, and of "=" and a whole
    word that is misread its word. A paragraph ends with a sentence, where an empty line follows, or a line that is short; over a page
    break, which leaves empty lines of its own, where the next word would have fitted into the line.
    """
    first, lines, breaks, kinds = layout(text, weights)
    at = [i for i, (x, k) in enumerate(zip(lines, kinds)) if not k and x.strip()]
    body = [lines[i].strip() for i in at]
    sizes = sorted(map(len, body))
    width, widest = (sizes[int(len(sizes) * 0.85)], sizes[-1]) if sizes else (0, 0)

    def begins(n: int) -> bool:
        if PLAIN.fullmatch(body[n]):  # of a numbered list: other lines with only a number are furniture
            return True
        before, line = body[n - 1], body[n]
        if PLAIN.fullmatch(before) or line[0].islower() or before.rstrip("\"'”’»)")[-1:] not in ".!?…:":
            return False
        if len(before) < 0.72 * width:
            return True
        between = range(at[n - 1] + 1, at[n])
        if any(kinds[i] for i in between) or any(i in breaks for i in range(at[n - 1] + 1, at[n] + 1)) or len(between) > 1:
            return len(before) + 1 + len(line.split()[0]) <= widest
        return len(between) == 1

    paragraphs, now, glued = [], "", True
    walked = list(walk(body))
    for n, (skip, words, h, b, joined) in enumerate(walked):
        line = body[n]
        if n and not glued:
            if begins(n):
                paragraphs.append(now)
                now = ""
            else:
                now += " "
        pos = skip
        for s, e, w in words:
            now += line[pos:s] + fixes.get(w, line[s:e])
            pos = e
        if joined:
            whole = fixes.get(f"{h[1]}\n{b[0]}", h[1] + b[0])
            further = walked[n + 1][4] and walked[n + 1][2].start() < b.end()
            whole = whole if further else fixes.get("=" + whole, whole)
            # A word over three lines: its middle stands at the end already.
            now = now + line[pos : h.start()] + whole if h.start() >= skip else now.removesuffix(h[1]) + whole
        else:
            now += line[pos:]
        glued = h is not None
    return "\n\n".join([first, *paragraphs, *([now] if body else [])])


def parsed(df: DataFrame, id_col: str, text: str, weights: np.ndarray) -> DataFrame:
    """(id, headers, pages, broken, words) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(t, weights)[:4] for t in b.column(1).to_pylist()]
            broken = pa.array([[{"a": x, "b": y} for x, y in r[2]] for r in rows], pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)), broken, pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["id", "headers", "pages", "broken", "words"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(run, "id long, headers array<string>, pages array<string>, broken array<struct<a: string, b: string>>, words array<string>")


def lookalike(w: Column) -> Column:
    """One form for words that a scanner may take for each other: wide letters as the pair that they look like, the others by shape."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("d", "cl")):
        w = F.replace(w, F.lit(a), F.lit(b))
    return F.translate(w, "ca0h68fi1jq95", "eoobbbtlllggs")


def grams(w: Column) -> Column:
    padded = F.concat(F.lit("#"), lookalike(w), F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def candidates(forms: DataFrame, good: DataFrame) -> DataFrame:
    """forms (w, n) x good (c, m): pairs that share SHARED_GRAMS of their look-alike bigrams, found through the bigrams' inverted lists."""
    gap = 2  # characters by which look-alike forms may differ in length
    left = forms.select("w", "n", F.length(lookalike(F.col("w"))).alias("wl"), grams(F.col("w")).alias("gs")).select("w", "n", "wl", F.size("gs").alias("wg"), F.explode("gs").alias("g"))
    right = good.select("c", "m", F.length(lookalike(F.col("c"))).alias("cl"), grams(F.col("c")).alias("gs")).select("c", "m", "cl", F.size("gs").alias("cg"), F.explode("gs").alias("g"))
    pairs = left.join(right, "g").filter((F.abs(F.col("wl") - F.col("cl")) <= gap) & (F.col("m") >= RARER * F.col("n")) & (F.col("w") != F.col("c")))
    pairs = pairs.groupBy("w", "n", "c", "m", "wg", "cg").agg(F.count("*").alias("s"))
    return pairs.withColumn("shared", F.col("s") / F.greatest("wg", "cg")).filter(F.col("shared") >= SHARED_GRAMS).select("w", "n", "c", "m", "shared")


def with_features(pairs: DataFrame) -> DataFrame:
    p = pairs.withColumn("edits", F.levenshtein("w", "c").cast("double")).withColumn("folded_edits", F.levenshtein(lookalike(F.col("w")), lookalike(F.col("c"))).cast("double"))
    p = p.withColumn("longer", (F.length("c") - F.length("w")).cast("double")).withColumn("rarer", F.least(F.log(F.col("m") / F.col("n")), F.lit(9.0)))
    p = p.withColumn("same_first", (F.substring("w", 1, 1) == F.substring("c", 1, 1)).cast("double")).withColumn("size", F.least(F.length("c"), F.lit(12)).cast("double"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(p)


def corrupt(word: str, how: random.Random) -> str:
    """One or two letters of a word as a scanner may read them."""
    for _ in range(how.choice((1, 1, 1, 2))):
        places = [(i, a, b) for a, b in CONFUSED for i in range(len(word)) if word.startswith(a, i)]
        if places:
            i, a, b = how.choice(places)
            word = word[:i] + b.lower() + word[i + len(a) :]
    return word


def altered(word: str, how: random.Random) -> str:
    """A word with one letter put in, left out or put in the place of another: another word, as far as scanners know."""
    i, c = how.randrange(len(word)), how.choice("abcdefghijklmnopqrstuvwxyz")
    return word[:i] + how.choice((c, c + word[i], "", c, word[i] + "s")) + word[i + 1 :]


def ranking(good: DataFrame, seed: int):  # noqa: ANN201
    """Boosted trees over pairs of a form and a candidate. They learn from the TRAIN_WORDS most frequent words: each corrupted in
    TRAIN_FORMS ways and given a count as much rarer, against the other candidates of the same forms; as they are, against each other;
    and altered in ways that no scanner has, which are rare words of their own."""
    known = good.orderBy(F.desc("m"), "c").limit(TRAIN_WORDS)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, m in b[["c", "m"]].itertuples(index=False, name=None):
                how = random.Random(f"{seed}{c}")
                for _ in range(TRAIN_FORMS):
                    if (w := corrupt(c, how)) != c:
                        out.append((w, max(1, int(m / how.choice((10, 30, 100, 300, 1000)))), c))
                    if (w := altered(c, how)) != c:
                        out.append((w, max(1, int(m / how.choice((10, 100, 1000)))), ""))
                out.append((c, m, ""))
                out.append((c, max(1, int(m / how.choice((6, 10, 100, 1000)))), ""))
            yield pd.DataFrame(out, columns=["w", "n", "truth"])

    made = cut(known.mapInPandas(forms, "w string, n long, truth string"))
    plain = made.groupBy("w").agg(F.min("n").alias("n"), F.max("truth").alias("truth"))
    pairs = with_features(candidates(plain.select("w", "n"), good)).join(plain.select("w", "truth"), "w").withColumn("label", (F.col("c") == F.col("truth")).cast("double"))
    train = cut(pairs.select("features", "label"))
    if train.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=12, maxDepth=4, seed=seed).fit(train)


def replacements(counts: DataFrame, seed: int = 11, more: DataFrame | None = None) -> DataFrame:
    """(w, c): misread forms and their words, from (w, n), the number of documents of each form. more: forms (w, n) that counts hasn't."""
    good = counts.filter(F.col("n") >= GOOD_DOCS).select(F.col("w").alias("c"), F.col("n").alias("m"))
    model = ranking(good, seed)
    top = counts.agg(F.max("n")).first()[0] or 0
    # A number can't be told from another, so only forms with a letter are looked at.
    forms = counts if more is None else counts.unionByName(more)
    pairs = with_features(candidates(forms.filter((F.col("n") * RARER <= top) & F.col("w").rlike(r"\p{L}")), good))
    # Where no two frequent words are alike there is nothing to rank: a form has its one look-alike.
    p = pairs.withColumn("p", (F.col("folded_edits") == 0).cast("double")) if model is None else model.transform(pairs).withColumn("p", vector_to_array("probability")[1])
    scored = p.filter(F.col("p") >= SURE)
    best = scored.groupBy("w").agg(F.max_by("c", F.struct(F.round("p", 1), -F.col("edits"), "p", "m", "c")).alias("c"))
    # A replacement that is itself a misread form stands for its own word.
    return best.alias("x").join(best.select(F.col("w").alias("c"), F.col("c").alias("further")), "c", "left").select("w", F.coalesce("further", "c").alias("c"))


def in_case(word: Column, like: Column) -> Column:
    letters = F.regexp_replace(like, r"[^\p{L}]", "")
    like = F.regexp_replace(F.regexp_replace(like, r"^\^.", "X"), r"^[58](?=\p{L}{2})", "X")  # only the capitals B and S look so
    return F.when((letters == F.upper(letters)) & (F.length(letters) > 1), F.upper(word)).when(F.substring(like, 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(word, 1, 1)), F.expr("substring(c, 2)"))).otherwise(word)


def bare(word: Column) -> Column:
    return F.ltrim(F.lower(word), F.lit(MARK))


def counted(pages: DataFrame) -> DataFrame:
    """(w, n): number of documents of each word of the running text."""
    return cut(pages.select(F.explode("words").alias("word")).groupBy(bare(F.col("word")).alias("w")).agg(F.count("*").alias("n")))


def wholes(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, a, b, whole): the broken words of each document, with the hyphen where the corpus has it more often than not."""
    b = pages.select("id", F.explode("broken").alias("x")).select("id", "x.a", "x.b", F.concat("x.a", "x.b").alias("without"), F.concat("x.a", F.lit("-"), "x.b").alias("kept"))
    b = b.withColumn("lw", F.lower("without")).withColumn("lk", F.lower("kept"))
    b = b.join(counts.select(F.col("w").alias("lw"), F.col("n").alias("nw")), "lw", "left").join(counts.select(F.col("w").alias("lk"), F.col("n").alias("nk")), "lk", "left")
    return b.select("id", "a", "b", F.when(F.coalesce("nk", F.lit(0)) > F.coalesce("nw", F.lit(0)), F.col("kept")).otherwise(F.col("without")).alias("whole"))


def noise(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, noise_type, noise_text): distinct furniture lines, broken words and misread words of scanned texts.

    Null texts have none; the first line isn't looked at; repeated rows of one id count as one document's. A broken word keeps its
    hyphen where the corpus has it with the hyphen more often than without.
    """
    weights = line_weights(df, text)
    pages = cut(parsed(df, id_col, text, weights))
    lines = lambda field, kind: pages.select("id", F.lit(kind).alias("noise_type"), F.explode(field).alias("noise_text"))
    words = pages.select("id", F.explode("words").alias("word"))
    counts = counted(pages)
    hyphens = wholes(pages, counts).select("id", F.lit("hyphen").alias("noise_type"), F.col("whole").alias("noise_text"))
    mapping = cut(replacements(counts))
    found = words.withColumn("w", bare(F.col("word"))).join(broadcast_if_small(mapping, mapping.count(), MAPPING_BROADCAST), "w")
    misread = found.select("id", F.lit("misread").alias("noise_type"), in_case(F.col("c"), F.col("word")).alias("noise_text"))
    return lines("headers", "header").unionByName(lines("pages", "page_number")).unionByName(hyphens).unionByName(misread).distinct()


def repaired(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, repaired): each scanned text with what noise() finds taken out or set right in its place, and its paragraphs continuous
    (see repair). Broken words that are misread as well are set right too. A null text stays null; every row gives one row."""
    weights = line_weights(df, text)
    pages = cut(parsed(df, id_col, text, weights))
    counts = counted(pages)
    broken = cut(wholes(pages, counts).distinct())
    unseen = broken.groupBy(F.lower("whole").alias("w")).agg(F.countDistinct("id").alias("n")).join(counts, "w", "left_anti")
    mapping = cut(replacements(counts, more=unseen))
    mapping = broadcast_if_small(mapping, mapping.count(), MAPPING_BROADCAST)
    words = pages.select("id", F.explode("words").alias("word")).withColumn("w", bare(F.col("word"))).join(mapping, "w")
    misread = broken.withColumn("w", F.lower("whole")).join(mapping, "w")
    fixes = words.select("id", F.col("word").alias("k"), in_case(F.col("c"), F.col("word")).alias("v"))
    fixes = fixes.unionByName(broken.select("id", F.concat("a", F.lit("\n"), "b").alias("k"), F.col("whole").alias("v")))
    fixes = fixes.unionByName(misread.select("id", F.concat(F.lit("="), "whole").alias("k"), in_case(F.col("c"), F.col("whole")).alias("v"))).distinct()
    fixes = fixes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fixes"))
    texts = df.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("text"))
    texts = texts.join(fixes, F.col("i").eqNullSafe(F.col("id")), "left").select("i", "text", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [None if t is None else repair(t, dict(f or ()), weights) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["id", "repaired"])

    return texts.mapInArrow(run, "id long, repaired string")
