"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (text between block-level tags).
Each block is a vector: hashed tags, classes and ids of its path, hashed words,
and a few shape numbers. A bidirectional LSTM in numpy reads the whole sequence
in both directions and labels every block as article or not, so a block is
judged in the context of all the others.

The labeller is trained here, on a bounded sample of pages (``TRAIN_PAGES``, by
hash). Blocks get weak labels from the roles their tags and class names state;
variants of each page, with menus, sidebars, notices, forms, adverts and comments
of other wording put around and into the article and with other article
containers, teach it sites it has not seen.

Defined results: null or empty html, or a page without article blocks, gives the
empty text; scripts, styles and comments are never blocks; character references
are decoded; unclosed tags end where their container ends; repeated rows and null
ids are pages like any; an empty table gives no rows. Columns other than the
html travel in one struct.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 192
VARIANTS = 8
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 384, 32, 6, 20
WINDOW, BATCH, EPOCHS = 40, 48, 20
#: A block goes if its log odds of being article are at most this: a lost sentence is worse than one too many.
DROPPED = -1.5
#: Blocks of a window of a very long page, and those read beside it.
LONG, MARGIN = 4096, 64

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: After the last ">": a comment or section that runs to the end.
UNENDED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
#: Tags whose names describe the whole page.
WHOLE = frozenset(("html", "body"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Start tags that end an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div body main aside nav form".split())

# What weak labels and page variants call the parts around an article.
OUTER_TAGS = ("head", "title", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "textarea",
              "noscript", "template", "dialog", "iframe")
OUTER_NAMES = ("ad", "ads", "advert", "advertisement", "adbox", "sponsored", "sponsor", "promo", "promotion", "banner",
               "cookie", "cookies", "consent", "gdpr", "notice", "alert", "sidebar", "menu", "nav", "navbar",
               "navigation", "footer", "header", "masthead", "topbar", "comment", "comments", "reply", "replies",
               "discussion", "respond", "related", "recommended", "share", "social", "newsletter", "subscribe",
               "signup", "login", "search", "popup", "modal", "overlay", "breadcrumb", "breadcrumbs", "pagination",
               "pager", "widget", "toolbar", "copyright", "legal", "disclaimer", "complementary", "contentinfo", "tags")
#: Words that a name of such a part may have beside its own; with any other it names something else.
QUALIFIERS = frozenset("site page main top bottom left right box list inner outer wrap wrapper container area block section "
                       "primary secondary global local fixed sticky mobile desktop small large row col item items text body "
                       "content bar group panel holder module div region links link the a".split())
#: Marks a generated part as outside while it is made; never a name the labeller sees.
HIDDEN_NAME = "zzoutside"
INNER = ("<article>", '<main><article class="post">', '<div class="content">', '<div id="main-content">',
         '<section class="entry">', '<div class="article-body">', '<div class="post story">', "<main>")


def name_tokens(name: str) -> list[str]:
    """Path tokens of one class, id or role: its words, if they say what part of a page it is.

    In ``no-sidebar`` or ``social-science-article`` an outer part's word is not what the name means; there
    only the words count that are neither such a word nor one that goes with it.
    """
    words = [w.lower() for w in NAME.findall(name)]
    other = [w for w in words if w not in OUTER_NAMES and w not in QUALIFIERS]
    return ["n:" + w for w in (other if other and any(w in OUTER_NAMES for w in words) else words)]


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, distinct path tokens, share of linked characters) of the leaf blocks, in page order."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    tags: Counter = Counter()  # open ones
    names_open: dict[str, int] = {}  # path tokens of the open tags, each once, in order of opening
    linked = pos = 0
    last = page.rfind(">")  # no tag ends after it

    def flush():
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(buffer)).split())
        if text:
            out.append((text, tuple(names_open), min(1.0, linked / len(text))))
        buffer.clear()
        linked = 0

    def add(piece):
        nonlocal linked
        buffer.append(piece)
        if tags["a"]:
            linked += len(piece)

    def close(i):
        for tag, names in stack[i:]:
            tags[tag] -= 1
            for n in names:
                names_open[n] -= 1
                if not names_open[n]:
                    del names_open[n]
        del stack[i:]

    while pos < len(page):
        m = TOKEN.search(page, pos) if pos <= last else UNENDED.search(page, pos)
        if not m:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        tag = (m.group(2) or m.group(5) or "").lower() if m.re is TOKEN else ""
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                add(m.group()[9:-3])
            continue
        if tag not in INLINE:
            flush()
        if m.group(1) or m.group(4):
            for i in range(len(stack) - 1, -1, -1) if tags[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        attrs = m.group(3) if m.group(2) else m.group(6)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag not in SCOPES and tag != "p":
            continue
        closes = CLOSES.get(tag, set()) | ({"p"} if tag not in INLINE else set())
        for i in range(len(stack) - 1, -1, -1) if any(tags[c] for c in closes) else ():
            if stack[i][0] in closes:
                close(i)
                break
            if stack[i][0] in SCOPES:
                break
        names = ["t:" + tag]
        if tag not in WHOLE:
            for a in ATTRIBUTE.finditer(attrs):
                for name in (a.group(2) or a.group(3) or a.group(4) or "").split():
                    names += name_tokens(name)
        stack.append((tag, tuple(names)))
        tags[tag] += 1
        for n in names:
            names_open[n] = names_open.get(n, 0) + 1
    flush()
    return out


def weak_label(path: tuple[str, ...]) -> int:
    """1 if nothing on the path states a role outside the article."""
    return int(not any(t[2:] in OUTER_TAGS if t[0] == "t" else t[2:] in OUTER_NAMES for t in path))


def _slot(token: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % dim, 1.0 if h & 0x40000000 else -1.0


class Encoder:
    """Block vectors; remembers the slots of paths and words.

    Path tokens that are not ``known`` (None: all are) have no slot, so that a name never seen in
    training says nothing instead of what shares its slot says.
    """

    def __init__(self, known: frozenset[str] | None = None):
        self.known = known
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = np.zeros(PATH_DIM, dtype=np.float32)
            for t in path if self.known is None else (t for t in path if t in self.known):
                i, sign = _slot(t, PATH_DIM)
                v[i] += sign
            self.paths[path] = v
        return self.paths[path]

    def word(self, w: str) -> int:
        if w not in self.words:
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[w] = zlib.crc32(w.lower().encode()) % WORD_DIM
        return self.words[w]

    def __call__(self, leaves: list[tuple[str, tuple[str, ...], float]], first: int = 0, total: int = 0) -> np.ndarray:
        """Vectors of the leaves, which begin at leaf ``first`` of a page of ``total`` (0: are all of it)."""
        x = np.zeros((len(leaves), PATH_DIM + WORD_DIM + SHAPE_DIM), dtype=np.float32)
        for i, (text, path, linked) in enumerate(leaves):
            words = text.split()
            x[i, :PATH_DIM] = self.path(path)
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount([self.word(w) for w in words],
                                                            minlength=WORD_DIM) / len(words)
            x[i, -SHAPE_DIM:] = (np.log1p(len(words)) / 5, linked, (first + i) / (total or len(leaves)), len(path) / 10,
                                 text.count(",") / len(words), text.count(".") / len(words))
        return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _direction(p: dict, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of one LSTM over x (T, B, D); masked steps keep the state."""
    steps, batch, _ = x.shape
    n = p["u"].shape[0]
    z = x.reshape(steps * batch, -1) @ p["w"] + p["b"]
    z = z.reshape(steps, batch, 4 * n)
    h = c = np.zeros((batch, n), dtype=x.dtype)
    out = np.empty((steps, batch, n), dtype=x.dtype)
    for t in range(steps):
        a = z[t] + h @ p["u"]
        gates = _sigmoid(a[:, :3 * n])
        i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(a[:, 3 * n:])
        m = mask[t][:, None]
        c_new = f * c + i * g
        th = np.tanh(c_new)
        if trace is not None:
            trace.append((h, c, i, f, o, g, th, m))
        c = np.where(m, c_new, c)
        h = np.where(m, o * th, h)
        out[t] = h
    return out


def _direction_back(p: dict, x: np.ndarray, trace: list, dout: np.ndarray) -> dict:
    steps, batch, dim = x.shape
    n = p["u"].shape[0]
    da_all = np.empty((steps, batch, 4 * n), dtype=x.dtype)
    du = np.zeros_like(p["u"])
    dh = dc = np.zeros((batch, n), dtype=x.dtype)
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, g, th, m = trace[t]
        dh = dh + dout[t]
        live = np.where(m, dh, 0)
        dcn = np.where(m, dc, 0) + live * o * (1 - th * th)
        da = np.concatenate([dcn * g * i * (1 - i), dcn * c0 * f * (1 - f), live * th * o * (1 - o),
                             dcn * i * (1 - g * g)], axis=1)
        da_all[t] = da
        du += h0.T @ da
        dh = np.where(m, da @ p["u"].T, dh)
        dc = np.where(m, dcn * f, dc)
    flat = da_all.reshape(steps * batch, 4 * n)
    return {"w": x.reshape(steps * batch, dim).T @ flat, "u": du, "b": flat.sum(axis=0)}


class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, dim: int, hidden: int = HIDDEN, seed: int = 4):
        self.known: frozenset[str] | None = None
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in ("fw", "bw"):
            self.p[d] = {"w": rng.normal(0, dim ** -0.5, (dim, 4 * hidden)).astype(np.float32),
                         "u": rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden)).astype(np.float32),
                         "b": np.zeros(4 * hidden, dtype=np.float32)}
            self.p[d]["b"][hidden:2 * hidden] = 1
        self.p["out"] = {"w": rng.normal(0, 0.1, (2 * hidden + dim,)).astype(np.float32),
                         "b": np.zeros(1, dtype=np.float32)}

    def _states(self, x, mask, traces=None):
        fw = _direction(self.p["fw"], x, mask, traces[0] if traces else None)
        bw = _direction(self.p["bw"], x[::-1], mask[::-1], traces[1] if traces else None)[::-1]
        return np.concatenate([fw, bw, x], axis=2)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._states(x, mask) @ self.p["out"]["w"] + self.p["out"]["b"]

    def gradients(self, x, mask, y):
        """Mean log loss over the unmasked blocks, and its gradients."""
        traces: tuple[list, list] = ([], [])
        s = self._states(x, mask, traces)
        prob = _sigmoid(s @ self.p["out"]["w"] + self.p["out"]["b"])
        count = mask.sum()
        loss = -(np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)) * mask).sum() / count
        d = ((prob - y) * mask / count).astype(np.float32)
        n = self.p["fw"]["u"].shape[0]
        ds = d[:, :, None] * self.p["out"]["w"]
        return loss, {"out": {"w": np.tensordot(d, s, axes=((0, 1), (0, 1))), "b": np.array([d.sum()])},
                      "fw": _direction_back(self.p["fw"], x, traces[0], ds[:, :, :n]),
                      "bw": _direction_back(self.p["bw"], x[::-1], traces[1], ds[::-1, :, n:2 * n])}

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01,
            seed: int = 4) -> float:
        """Adam over random windows of the sequences; returns the last epoch's mean loss."""
        rng = random.Random(seed)
        moments = {k: {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in q.items()} for k, q in self.p.items()}
        step, mean = 0, 0.0
        for epoch in range(epochs):
            order = list(range(len(sequences)))
            rng.shuffle(order)
            losses = []
            for at in range(0, len(order), BATCH):
                part = []
                for i in order[at:at + BATCH]:
                    x, y = sequences[i]
                    # half of the windows hold an end of the page, where the parts change
                    last = max(0, len(x) - WINDOW)
                    start = rng.choice([0, last, rng.randint(0, last)])
                    part.append((x[start:start + WINDOW], y[start:start + WINDOW]))
                loss, grads = self.gradients(*_padded([x for x, _ in part], [y for _, y in part]))
                losses.append(loss)
                step += 1
                lr = rate * (0.3 if epoch > epochs * 0.7 else 1.0)
                for k, q in grads.items():
                    for name, g in q.items():
                        m = moments[k][name]
                        m[0] = 0.9 * m[0] + 0.1 * g
                        m[1] = 0.999 * m[1] + 0.001 * g * g
                        move = lr * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
                        self.p[k][name] = (self.p[k][name] - move).astype(np.float32)
            mean = float(np.mean(losses)) if losses else 0.0
        return mean

    def label(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Article or not, for every block of every sequence; equal lengths share a pass."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            longest = len(sequences[order[min(at + 63, len(order) - 1)]])
            take = max(1, min(64, 20_000 // longest))
            part = order[at:at + take]
            x, mask, _ = _padded([sequences[i] for i in part], None)
            z = self.logits(x, mask)
            for j, i in enumerate(part):
                out[i] = z[:len(sequences[i]), j] > DROPPED
            at += take
        return out


def _padded(xs, ys):
    steps = max(len(x) for x in xs)
    x = np.zeros((steps, len(xs), xs[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(xs)), dtype=bool)
    y = np.zeros((steps, len(xs)), dtype=np.float32)
    for i, own in enumerate(xs):
        x[:len(own), i], mask[:len(own), i] = own, True
        if ys is not None:
            y[:len(own), i] = ys[i]
    return x, mask, y


def _section(rng: random.Random, words: list[str]) -> str:
    """One part that is not article: a menu, sidebar, notice, form, advert or comments."""
    def say(n):
        return " ".join(rng.choice(words) for _ in range(max(1, n)))

    body = rng.choice([
        lambda: "<ul>" + "".join(f'<li><a href="#">{say(rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>",
        lambda: rng.choice([" ", " | ", "<br>"]).join(f'<a href="#">{say(rng.randint(1, 2))}</a>' for _ in range(rng.randint(2, 8))),
        lambda: "".join(f"<p>{say(rng.randint(3, 60))}.</p>" for _ in range(rng.randint(1, 4))),
        lambda: say(rng.randint(2, 25)),
        lambda: f"<h3>{say(2)}</h3>" + "".join(f"<div><span>{say(1)}</span><p>{say(rng.randint(3, 50))}</p></div>"
                                               for _ in range(rng.randint(1, 4))),
        lambda: f"<label>{say(2)}</label><input><button>{say(1)}</button>"])()
    if rng.random() < 0.4:
        tag = rng.choice([t for t in OUTER_TAGS if t not in ("head", "title", "template", "iframe")])
        return f"<{tag}>{body}</{tag}>"
    if "<a " in body or "<label" in body:  # what it is shows without a name
        if rng.random() < 0.5:
            tag = rng.choice(["div", "div", "ul", "p", "section", "td"])
            other = rng.choice(["", "", f"{rng.choice(words).lower()} ", f"{rng.choice(words).lower()}-{rng.choice(words).lower()} "])
            return f'<{tag} class="{other}{HIDDEN_NAME}">{body}</{tag}>'
    name = rng.choice(OUTER_NAMES)
    name = rng.choice([name, name, f"{name}-{rng.choice(['box', 'list', 'inner', 'wrap', 'top', 'left'])}",
                       f"site-{name}", f"{rng.choice(['page', 'main'])} {name}"])
    tag = rng.choice(["div", "div", "section", "ul", "p"])
    return f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{name}\">{body}</{tag}>"


def _paragraph(rng: random.Random, words: list[str]) -> str:
    """One block of an article; some words may be linked."""
    tag = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "td", "div"])
    said = [rng.choice(words) for _ in range(rng.randint(1, 80))]
    if rng.random() < 0.2 and len(said) > 8:
        at = rng.randrange(len(said) - 4)
        said[at], said[at + 2] = '<a href="#">' + said[at], said[at + 2] + "</a>"
    return f"<{tag}>{' '.join(said)}"


def training_sequences(pages: list[str], encode: Encoder, variants: int = VARIANTS, seed: int = 4):
    """Block vectors and weak labels of the pages and of variants with other parts and containers.

    An encoder without known path tokens gets those that a hundredth of these pages have.
    """
    rng = random.Random(seed)
    vocabulary = sorted({w for p in pages[:50] for b in blocks(p) for w in b[0].split()[:40]}) or ["text"]
    out = []
    for page in pages:
        made = [page]
        for _ in range(variants):
            # each variant has few words of its own, partly of no language, so that words alone say little
            words = rng.choices(vocabulary, k=rng.randint(5, 200))
            words += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) + rng.choice(["", "", "", ",", "."])
                      for _ in range(rng.randint(5, 60))]
            body = "".join(_paragraph(rng, words) for _ in range(rng.randint(1, 25)))
            if rng.random() < 0.3:
                cut = body.find("<", len(body) // 2)
                body = body[:cut] + _section(rng, words) + body[cut:] if cut > 0 else body
            start = rng.choice(INNER)
            if rng.random() < 0.45:  # containers whose names say nothing
                one, two = rng.choice(words).lower(), rng.choice(words).lower()
                start = rng.choice(["<div>", "<div><div>", "<table><tr><td>", f'<div class="{one}-{two}">', f'<section id="{one}">',
                                    f'<div class="{rng.choice(OUTER_NAMES)}-{one}-{two}">'])
            end = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", start)))
            before = "".join(_section(rng, words) for _ in range(rng.randint(0, 4)))
            after = "".join(_section(rng, words) for _ in range(rng.randint(0, 4)))
            made.append(f"<html><head><title>{rng.choice(words)}</title></head><body>{before}{start}<h1>{rng.choice(words)}"
                        f" {rng.choice(words)}</h1>{body}{end}{after}</body></html>")
        for m in made:
            leaves = blocks(m)
            hidden = "n:" + HIDDEN_NAME
            if leaves:
                seen = [(t, tuple(n for n in path if n != hidden), linked) for t, path, linked in leaves]
                out.append((seen, np.array([weak_label(path) * (hidden not in path) for _, path, _ in leaves], dtype=np.float32)))
    if encode.known is None:
        held_by = Counter(t for leaves, _ in out for t in {t for _, path, _ in leaves for t in path})
        encode.known = frozenset(t for t, n in held_by.items() if n >= max(2, len(out) / 100))
    return [(encode(leaves), y) for leaves, y in out]


def train(pages: DataFrame, html_col: str = "html", bound: int = TRAIN_PAGES) -> BlockLabeller:
    """Fit the labeller on ``bound`` distinct pages, the first by hash of their html.

    Only pages of a hash range that holds about twice as many distinct ones are ordered, so the tasks of
    a large table send few pages each; were the range empty, all pages are.
    """
    hashed = F.xxhash64("html")
    rows = pages.select(F.col(html_col).cast("string").alias("html")).where(F.length("html") > 0)
    share = min(1.0, 2 * bound / max(1, rows.select(hashed.alias("h")).distinct().count()))

    def first(share: float) -> list:
        near = rows.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
        return near.dropDuplicates(["html"]).orderBy(hashed, "html").limit(bound).collect()

    sample = first(share) or first(1.0)
    encode = Encoder()
    model = BlockLabeller(PATH_DIM + WORD_DIM + SHAPE_DIM)
    sequences = training_sequences([r["html"] for r in sample], encode)
    if sequences:
        model.fit(sequences)
        model.known = encode.known
    return model


def label_pages(model: BlockLabeller, encode: Encoder, pages: list[list]) -> list[np.ndarray]:
    """Article or not, for the blocks of each page.

    A page of more than ``LONG`` blocks is read in windows, each with ``MARGIN`` blocks more on either side.
    """
    short = [x if len(x) <= LONG else [] for x in pages]
    out = model.label([encode(x) if x else np.zeros((0, 1)) for x in short])
    for i, x in enumerate(pages):
        if len(x) > LONG:
            parts = []
            for at in range(0, len(x), LONG):
                lo, hi = max(0, at - MARGIN), min(len(x), at + LONG + MARGIN)
                parts.append(model.label([encode(x[lo:hi], lo, len(x))])[0][at - lo:at - lo + LONG])
            out[i] = np.concatenate(parts)
    return out


def extract_text(pages: DataFrame, model: BlockLabeller, *, html_col: str = "html",
                 keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``keep``, default all columns but the html), ``blocks`` (texts kept), ``text``."""
    keep = keep or [c for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(model.known)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                leaves = [blocks(h or "") for h in part.column(1).to_pylist()]
                labels = label_pages(model, encode, leaves)
                kept = [[t for (t, _, _), y in zip(x, ys) if y] for x, ys in zip(leaves, labels)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.list_(pa.string())), pa.array([" ".join(k) for k in kept], pa.string())],
                    names=["row", "blocks", "text"])

    return rows.mapInArrow(run, f"row {kind}, blocks array<string>, text string")
