"""Main text of web pages by a linear-chain conditional random field
(operator 9).

A page is cut into leaf blocks: the text between block-level tags, in page
order.  Each block has features of its ancestor tags, of the words in their
class, id and role attributes, and of its text (length, share of link text,
closing punctuation, place).  A linear-chain CRF with the labels text / rest is
trained by gradient ascent on the log-likelihood (forward-backward in numpy)
and decoded by Viterbi; blocks labelled text are joined by line feeds.

Labelled pages: of a bounded sample (``SAMPLE`` pages by hash of their id) the
pages that mark their article up (``article`` or ``main``) give labels: inside
and not within a part that is no article text (menu, form, comments ...) is
text.  Their blocks are also laid out again in other page designs with the same
labels (``DESIGNS``: other containers, side bars, notices, adverts, forms,
reader comments), so that the model does not hang on one tag.  Without any
such page the designs are filled with stock sentences.

Reading and decoding are per row; nothing is shuffled.  The model has a fixed
size.  Null or empty pages give an empty text, also pages without any text
block.  Character references are decoded, white space inside a block is one
blank.  Comments, scripts, styles and markup never reach a block; an unclosed
one ends with the page.  Rows that repeat get equal results.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import with_columns
from vigilo.sources.tables import read_table

SAMPLE = 240
ROUNDS, RATE, PENALTY = 200, 0.3, 2e-4

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|option|button)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr br img input".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id and role attributes, by what they hint at.
HINTS = {
    "menu": "nav|menu|breadcrumb|pagination|pager|tabs|toolbar",
    "header": "header|masthead|banner|topbar|logo|branding",
    "footer": "footer|copyright|legal|imprint|credits",
    "side": "side|aside|widget|related|recommend|popular|trending|more-|teaser|promo",
    "advert": r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|banner-ad|adbox",
    "notice": "cookie|consent|notice|alert|popup|modal|overlay|newsletter|subscri|gdpr|warning|paywall",
    "form": "form|login|signup|sign-in|search|register|input",
    "comment": "comment|reply|replies|discuss|respond|feedback|disqus|review",
    "share": "share|social|follow|tags|author|byline|meta(?:$|[\\s_-])|tool",
    "text": "content|article|post|entry|story|main|body|text|prose|page",
}
_HINTS = [(k, re.compile(v, re.I)) for k, v in HINTS.items()]
_TAGS = ("article main nav header footer aside form section ul ol table figure blockquote dl pre head fieldset "
         "details dialog address hgroup div").split()
_OWN = "p h1 h2 h3 h4 h5 h6 li td th div body article main section blockquote pre dt dd figcaption footer header nav aside form".split()
_WORDS = (1, 2, 4, 8, 16, 32, 64)
_MORE = ("bias links_some links_most links_all ends_sentence has_comma no_lower copyright first last early late "
         "title_before after_comment_head digits").split()
FEATURES = {f: i for i, f in enumerate([*(f"in_{t}" for t in _TAGS), *(f"own_{t}" for t in _OWN), *(f"hint_{k}" for k in HINTS),
                                        *(f"words_{w}" for w in _WORDS), *_MORE])}
_COMMENT_HEAD = re.compile(r"^\W*(?:\d+\s+)?(?:comments?|kommentare?|commentaires?|comentarios?|replies|responses)\b", re.I)
_not_text = ("nav", "header", "footer", "aside", "form", "dialog", "fieldset")


class Block:
    __slots__ = ("text", "path", "own", "link_chars")

    def __init__(self, text: str, path: tuple, own: str, link_chars: int):
        self.text, self.path, self.own, self.link_chars = text, path, own, link_chars


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text, ancestors (tag, attribute words), nearest tag."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, tuple(stack), stack[-1][0] if stack else "body", link_chars))
        parts.clear()
        link_chars = 0

    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if links:
                link_chars += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:  # a comment, declaration or raw part
            if m["raw"]:
                parts.append(" ")
            continue
        tag, end = tag.lower(), m["end"] or m["end2"]
        if tag in _INLINE:
            if tag == "a":
                links = 0 if end else 1
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        links = 0
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID:
            if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()  # a block tag closes an open paragraph
            closes = _CLOSED_BY.get(tag)
            while closes and stack and stack[-1][0] in closes:
                stack.pop()
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(m["attrs"] or "")) if m["attrs"] else ""
            if not (m["attrs"] or "").endswith("/"):
                stack.append((tag, names.lower()))
    flush()
    return out


_paths: dict[tuple, list[int]] = {}


def _path_features(path: tuple, own: str) -> list[int]:
    found = _paths.get((path, own))
    if found is None:
        if len(_paths) > 20000:
            _paths.clear()
        tags = {t for t, _ in path}
        found = [FEATURES[f"in_{t}"] for t in _TAGS if t in tags]
        if f"own_{own}" in FEATURES:
            found.append(FEATURES[f"own_{own}"])
        names = [n for t, n in path if n and t not in ("html", "body")]
        found += [FEATURES[f"hint_{k}"] for k, p in _HINTS if any(p.search(n) for n in names)]
        _paths[(path, own)] = found
    return found


def features(page: list[Block]) -> list[list[int]]:
    """Indices of the features that hold, per block."""
    out, f = [], FEATURES
    n, seen_title, comments = len(page), False, False
    for i, b in enumerate(page):
        t = b.text
        own = [*_path_features(b.path, b.own), f["bias"]]
        words = t.count(" ") + 1
        own += [f[f"words_{w}"] for w in _WORDS if words >= w]
        share = b.link_chars / len(t)
        if share > 0.1:
            own.append(f["links_some"])
            if share > 0.5:
                own.append(f["links_most"])
                if share > 0.9:
                    own.append(f["links_all"])
        if t[-1] in ".!?…\"”»":
            own.append(f["ends_sentence"])
        if "," in t:
            own.append(f["has_comma"])
        if t == t.upper():
            own.append(f["no_lower"])
        if "©" in t:
            own.append(f["copyright"])
        if any(c.isdigit() for c in t[:40]):
            own.append(f["digits"])
        own += [f[k] for k, yes in (("first", i == 0), ("last", i == n - 1), ("early", 4 * i < n), ("late", 4 * i >= 3 * n),
                                    ("title_before", seen_title), ("after_comment_head", comments)) if yes]
        seen_title = seen_title or b.own == "h1"
        comments = comments or bool(words <= 4 and _COMMENT_HEAD.match(t))
        out.append(own)
    return out


class Field:
    """Weights: per feature for the label text (rest is 0), per pair of labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def decode(self, page: list[Block]) -> list[bool]:
        """The best labels (Viterbi)."""
        if not page:
            return []
        w = self.weights
        score = [float(w[x].sum()) for x in features(page)]
        (rr, rt), (tr, tt) = self.pairs.tolist()
        rest, text, back = 0.0, score[0], []
        for s in score[1:]:
            from_rest, from_text = rest + rt, text + tt
            to_rest = (rest + rr, text + tr)
            back.append((to_rest[1] > to_rest[0], from_text >= from_rest))
            rest, text = max(to_rest), max(from_rest, from_text) + s
        label = text > rest
        out = [label]
        for was_rest, was_text in reversed(back):
            label = was_text if label else was_rest
            out.append(label)
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood by AdaGrad over all pages at once."""
    pages = [p for p in pages if p[0]]
    size = max((len(p) for p, _ in pages), default=1)
    x = np.zeros((len(pages), size, len(FEATURES)), dtype=np.float32)
    y = np.zeros((len(pages), size), dtype=np.int64)
    mask = np.zeros((len(pages), size), dtype=np.float32)
    for i, (page, labels) in enumerate(pages):
        for j, own in enumerate(features(page)):
            x[i, j, own] = 1
        y[i, :len(page)], mask[i, :len(page)] = labels, 1
    flat = x.reshape(-1, x.shape[2])
    w, t = np.zeros(x.shape[2]), np.zeros((2, 2))
    gw, gt = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    gold_w = flat.T @ (y * mask).reshape(-1)
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (y[:, :-1][mask[:, 1:] > 0], y[:, 1:][mask[:, 1:] > 0]), 1)
    total = max(1.0, mask.sum())
    for _ in range(rounds):
        s = np.stack([np.zeros(y.shape), (flat @ w.astype(np.float32)).reshape(y.shape)], axis=2)
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0]
        for j in range(1, size):
            step = np.logaddexp(fwd[:, j - 1, 0, None] + t[0], fwd[:, j - 1, 1, None] + t[1]) + s[:, j]
            fwd[:, j] = np.where(mask[:, j, None] > 0, step, fwd[:, j - 1])
        for j in range(size - 2, -1, -1):
            ahead = s[:, j + 1] + bwd[:, j + 1]
            step = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            bwd[:, j] = np.where(mask[:, j + 1, None] > 0, step, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * mask
        pair = np.exp(fwd[:, :-1, :, None] + t + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        dw = (gold_w - flat.T @ p.reshape(-1).astype(np.float32)) / total - PENALTY * w
        dt = (gold_t - pair.sum(axis=(0, 1))) / total - PENALTY * t
        gw += dw * dw
        gt += dt * dt
        w += RATE * dw / np.sqrt(gw)
        t += RATE * dt / np.sqrt(gt)
    return Field(w, t)


_not_text_hints = [p for k, p in _HINTS if k in ("menu", "side", "advert", "notice", "form", "comment", "share", "footer")]


def marked(page: list[Block]) -> list[bool] | None:
    """Labels of a page that marks its article up; None for others."""
    labels = []
    for b in page:
        inside = [i for i, (t, _) in enumerate(b.path) if t in ("article", "main")]
        below = b.path[inside[0] + 1:] if inside else ()
        labels.append(bool(inside) and not any(t in _not_text or any(p.search(n) for p in _not_text_hints) for t, n in below))
    return labels if any(labels) else None


_STOCK = ("The river rose for three days before it reached the old bridge, and nobody slept.", "Der Zug hielt lange auf freier Strecke.",
          "On ne savait pas encore ce que la nuit allait apporter.", "Llegaron tarde, pero la casa seguía en pie.",
          "A short note.", "In the morning the square was empty, apart from two dogs and a vendor with oranges.")
_SHORT = "Home News Sport About Contact Login Archive Help Shop Blog Travel More".split()
#: Containers of an article and its parts in other page designs; {} is filled with the article's blocks.
DESIGNS = (
    "<body><header><h2>{s}</h2></header><nav>{menu}</nav><article>{}</article><aside><h3>{s}</h3><p>{r}</p></aside><footer><p>{s}</p></footer>",
    "<body><div class='menu'>{menu}</div><div id='content'>{}</div><div class='sidebar'><p>{r}</p>{menu}</div><div class='footer'>© {s}</div>",
    "<body><div class='notice'>{r}</div><main>{}<section class='comments'><h3>3 Comments</h3><p>{r}</p><p>{r}</p></section></main><footer>{r}</footer>",
    "<body><div class='header'><a href='/'>{s}</a></div><div class='post-body'>{}</div><div class='ad'>{r}</div><div id='comments'><div>{r}</div><div>{r}</div></div>",
    "<body><ul>{items}</ul><article>{}<div class='ad'>{r}</div>{}<form><p>{s}</p><label>{s}</label></form></article><footer><p>© {r}</p></footer>",
    "<body><div role='navigation'>{menu}</div><div role='main'>{}</div><div role='complementary'><p>{r}</p></div><div class='cookie-banner'><p>{r}</p></div>",
    "<body><table><tr><td>{menu}</td><td class='story'>{}</td></tr></table><p class='copyright'>© {s}</p>",
    "<body><nav>{menu}</nav><section class='entry'>{}</section><section class='related'><h3>{s}</h3><ul>{items}</ul></section><div class='newsletter'><p>{r}</p></div>",
    "<body><p><a href='/'>{s}</a> <a href='/'>{s}</a></p>{}<p><a href='/'>{s}</a></p><p>© {s}</p>",
    "<body><article><header><nav>{menu}</nav></header>{}<footer><p>{s}</p></footer></article><div class='reader-comments'><ol><li>{r}</li><li>{r}</li></ol></div>",
)


def laid_out(parts: list[tuple[str, str]], others: list[str], design: str, rnd: random.Random) -> tuple[list[Block], list[bool]]:
    """An article's (tag, text) blocks in another design, with labels: the
    article's places are marked by a character no text holds."""
    mark = ""
    body = [f"<{t}>{mark}{html.escape(x)}</{t}>" for t, x in parts]
    cut = rnd.randrange(len(body) + 1) if design.count("{}") == 2 else len(body)
    chunks = iter(("".join(body[:cut]), "".join(body[cut:])))

    def fill(m: re.Match) -> str:
        kind = m[0]
        if kind == "{}":
            return next(chunks)
        if kind in ("{menu}", "{items}"):
            items = "".join(f"<li><a href='/x'>{w}</a></li>" for w in rnd.sample(_SHORT, rnd.randint(3, 7)))
            return items if kind == "{items}" else f"<ul>{items}</ul>"
        return html.escape(rnd.choice(others)) if kind == "{r}" else " ".join(rnd.sample(_SHORT, rnd.randint(1, 3)))

    page = blocks(re.sub(r"\{(?:menu|items|r|s)?\}", fill, design))
    labels = [mark in b.text for b in page]
    for b in page:
        b.text = b.text.replace(mark, "").strip() or "."
    return page, labels


def labelled(pages: list[str]) -> list[tuple[list[Block], list[bool]]]:
    """Training pages: the marked ones as they are, and in other designs."""
    rnd = random.Random(9)
    out, articles, rest = [], [], list(_STOCK)
    for page in map(blocks, pages):
        labels = marked(page)
        if labels:
            out.append((page, labels))
            articles.append([(b.own if b.own in ("h1", "h2", "h3", "p", "li", "blockquote") else "p", b.text)
                             for b, y in zip(page, labels, strict=True) if y][:40])
            rest += [b.text[:400] for b, y in zip(page, labels, strict=True) if not y and " " in b.text]
            rest += [b.text[:200] for b, y in zip(page, labels, strict=True) if y][1:2]
    if not articles:
        articles = [[("h1", rnd.choice(_STOCK)), *(("p", rnd.choice(_STOCK)) for _ in range(rnd.randint(1, 8)))] for _ in range(40)]
    for i, article in enumerate(articles):
        for k in (0, 1):
            out.append(laid_out(article, rest, DESIGNS[(2 * i + k) % len(DESIGNS)], rnd))
    return out


def sample(pages: DataFrame, key: str, page: str, size: int) -> list[str]:
    """At most ``size`` pages, chosen by the hash of their key."""
    ids = [r[0] for r in pages.select(F.col(f"`{key}`").alias("key")).distinct()
           .orderBy(F.xxhash64("key"), "key").limit(size).collect() if r[0] is not None]
    if not ids:
        return []
    rows = pages.filter(F.col(f"`{key}`").isin(ids)).select(F.col(f"`{key}`"), F.col(f"`{page}`").alias("page"))
    # Rows that repeat a key are one sample.
    return [r["page"] for r in rows.groupBy(F.col(key)).agg(F.min("page").alias("page")).orderBy(key).collect() if r["page"]]


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", size: int = SAMPLE) -> Field:
    return train(labelled(sample(pages, key, page, size)))


def extract(pages: DataFrame, model: Field, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of every row in one more column."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    return with_columns(pages, page, lambda rows: {text: [sent.value.text(r) for r in rows]}, f"{text} string")


def op9(spark, sf_dir: str) -> DataFrame:
    """``op9_html``: main text of every page."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
