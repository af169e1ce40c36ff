"""Labelled web pages for training: made by a grammar of page parts, each part known to be main text or not.

The grammar covers pages with and without sectioning elements, unclosed
paragraphs, headings, lists, quotes and tables inside articles, and around and inside them menus,
headers, footers, sidebars, notices, adverts, forms, scripts and reader comments. Besides pages mixed from
all of these there are templates that share no frame with each other: news, blog, table layout, manual and bare pages.
"""

from __future__ import annotations

import random
import re

#: Class and id names that page authors commonly use for each part.
NAMES = {
    "main": "article content post entry story main body text article-body post-content entry-content story-body main-content page-content".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav pagination pager tabs skip".split(),
    "header": "header masthead banner site-header top branding logo topbar site-title".split(),
    "footer": "footer site-footer copyright bottom colophon legal foot".split(),
    "aside": "sidebar aside related widget recommended popular trending tags side more-stories teaser archive author-box bio".split(),
    "notice": "notice cookie cookies consent gdpr alert banner-notice modal popup overlay newsletter subscribe paywall disclaimer message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox commercial dfp".split(),
    "form": "form search login signup search-form contact subscribe-form newsletter-form".split(),
    "comments": "comments comment reply replies discussion responses comment-list disqus commentlist reviews".split(),
    "share": "share social sharing share-buttons tools meta-tools".split(),
}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ment tion eau que ch un der sch ung keit ción ado mente é ü ñ zu pa la".split()


#: Scripts of the words, so that no word itself says anything.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшя", "αβγδεζηθικλμνξοπρστυφχψω", "日本語中文字学校時間人大小山川田水火木金土")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.letters = self.r.choice(("", "", *LETTERS))

    def word(self) -> str:
        if self.letters:
            return "".join(self.r.choice(self.letters) for _ in range(self.r.randint(1, 9)))
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, end: str = "") -> str:
        text = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return text[:1].upper() + text[1:] + end

    def sentences(self, low: int, high: int) -> str:
        joint = self.r.choice((" ", " ", " ", " | ", "!! "))
        return " ".join(self.words(2, 18).replace(" ", joint if self.r.random() < 0.2 else " ") + self.r.choice("....?!") for _ in range(self.r.randint(low, high)))

    def mark(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return text

    def name(self, part: str) -> str:
        if self.r.random() < 0.2:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{" ".join(self.r.sample(NAMES[part], self.r.choice((1, 1, 2))))}"'

    def paragraph(self) -> str:
        text = self.mark(self.sentences(1, 7) if self.r.random() < 0.85 else self.words(1, 6, self.r.choice((".", "", ","))))
        r = self.r.random()
        if r < 0.12:
            return f"<p><b>{text}<br>"
        if r < 0.25:
            return f"<p>{text}"
        if r < 0.32:
            cut = text.split(" ")
            k = self.r.randrange(len(cut))
            cut[k] = f'<a href="/{self.word()}">{cut[k]}</a>'
            return f"<p>{' '.join(cut)}</p>"
        if r < 0.38:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    def article(self) -> str:
        out = [f"<h1>{self.mark(self.words(1, 12))}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            out.append(self.paragraph())
            r = self.r.random()
            if r < 0.08:
                out.append(f"<h{self.r.randint(2, 4)}>{self.mark(self.words(1, 8))}</h2>")
            elif r < 0.13:
                out.append("<ul>" + "".join(f"<li>{self.mark(self.words(2, 14, '.'))}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif r < 0.16:
                out.append(f"<blockquote><p>{self.mark(self.sentences(1, 2))}</p></blockquote>")
            elif r < 0.18:
                out.append(f"<figure><img src=x><figcaption>{self.mark(self.words(3, 12, '.'))}</figcaption></figure>")
            elif r < 0.20:
                out.append("<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 3))}</td><td>{self.mark(self.words(1, 3))}</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>")
            elif r < 0.23:
                out.append(self.other(self.r.choice(("ad", "share", "notice", "aside"))))
        tag = self.r.choice(("article", "article", "article", "main", "div", "section"))
        name = self.name("main") if tag == "div" and self.r.random() < 0.9 or self.r.random() < 0.3 else ""
        return f"<{tag}{name}>" + "".join(out) + f"</{tag}>"

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(low, high))) + "</ul>"

    def other(self, part: str) -> str:
        r = self.r
        if part == "nav":
            body = self.links(2, 8) if r.random() < 0.8 else " &raquo; ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 6)))
            tag = r.choice(("nav", "nav", "div"))
        elif part == "header":
            body = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 8)}</p>" if r.random() < 0.5 else "") + (self.links(2, 6) if r.random() < 0.5 else "")
            tag = r.choice(("header", "header", "div"))
        elif part == "footer":
            body = f"&copy; {r.randint(1999, 2026) if r.random() < 0.5 else self.word() + '.example.net'} &middot; {self.sentences(1, 3)}" + (self.links(2, 5) if r.random() < 0.4 else "")
            tag = r.choice(("footer", "footer", "div"))
        elif part == "form":
            body = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(3, 12, '.')}</p>" if r.random() < 0.4 else "")
            tag = "form"
        elif part == "comments":
            inner = r.choice(('', ' class="comment"', ' class="reply"'))
            body = f"<h3>{r.randint(1, 40)} {self.words(1, 2)}</h3>" + "".join(f"<{'li' if k else 'div'}{inner}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></{'li' if k else 'div'}>" for k in [r.randint(0, 1) for _ in range(r.randint(1, 5))])
            tag = r.choice(("section", "div", "aside", "div"))
        elif part == "aside":
            body = f"<h3>{self.words(1, 4)}</h3>" + (self.links(2, 6) if r.random() < 0.6 else f"<p>{self.sentences(1, 3)}</p>")
            tag = r.choice(("aside", "aside", "div", "section"))
        else:
            body = r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f'<p>{self.words(2, 9, ".")}</p><a href="#">{self.words(1, 2)}</a>'))
            tag = r.choice(("div", "div", "aside", "section"))
        name = self.name(part)
        if tag in ("div", "section") and not name:
            name = f' class="{r.choice(NAMES[part])}"'
        return f"<{tag}{name}>{body}</{tag}>"

    def menu(self, low: int, high: int) -> str:
        """Links in a row or a list, with any separator."""
        r, links = self.r, [f'<a href="{self.word()}.html">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        gap = r.choice((" | ", " &gt; ", " - ", " ", "&nbsp;&nbsp;", ""))
        return r.choice((gap.join(links), "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", "".join(f"<div>{x}</div>" for x in links), "<br>".join(links)))

    def prose(self, low: int, high: int) -> list[str]:
        """Main blocks: paragraphs, and now and then a heading, list, quote or code."""
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            k = r.random()
            if k < 0.1:
                out.append(f"<h{r.randint(2, 4)}>{self.mark(self.words(1, 7))}</h{r.randint(2, 4)}>")
            elif k < 0.16:
                out.append(f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.mark(self.words(1, 14, r.choice(('', '.'))))}" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.2:
                out.append(f"<blockquote>{self.mark(self.sentences(1, 2))}</blockquote>")
            elif k < 0.23:
                out.append(f"<pre>{self.mark(self.words(3, 12))}</pre>")
            else:
                out.append(self.paragraph())
        return out

    def news(self) -> str:
        r, w = self.r, self.words
        rail = f'<div class="{r.choice(("right", "col-right", "rail", "column2"))}"><h4>{w(1, 3)}</h4>{self.menu(3, 8)}' + (f"<h4>{w(1, 2)}</h4><p>{w(3, 14)}</p>" if r.random() < 0.5 else "") + "</div>"
        story = self.prose(3, 14)
        if r.random() < 0.4:
            story.insert(r.randint(1, len(story)), f'<div class="{r.choice(("inset", "promo-box", "related-links"))}"><h5>{w(1, 3)}</h5>{self.menu(2, 4)}</div>')
        talk = f'<div id="talk"><h3>{w(1, 2)} ({r.randint(1, 90)})</h3>' + "".join(f'<div class="{r.choice(("comment", "entry-c", "comment-body"))}"><b>{w(1, 2)}</b> <i>{r.randint(1, 23)}:{r.randint(10, 59)}</i><p>{self.sentences(1, 3)}</p></div>' for _ in range(r.randint(1, 6))) + "</div>" if r.random() < 0.5 else ""
        return f'<div id="top">{w(1, 3)} {self.menu(4, 9)}</div><div class="wrap"><div class="{r.choice(("story", "left", "text", "artikel", "copy"))}"><h1 class="headline">{self.mark(w(2, 11))}</h1>{"".join(story)}</div>{rail}</div>{talk}<div id="bottom"><p>&copy; {r.randint(1990, 2030)} {w(1, 4)}</p>{self.menu(2, 5)}</div>'

    def blog(self) -> str:
        r, w = self.r, self.words
        side = "".join(f'<div class="{r.choice(("box", "block", "module", "widget"))}"><h3>{w(1, 3)}</h3>{r.choice((self.menu(3, 9), f"<p>{w(5, 25, chr(46))}</p>"))}</div>' for _ in range(r.randint(1, 4)))
        talk = f'<ol class="{r.choice(("commentlist", "replies", "thread"))}">' + "".join(f"<li><cite>{w(1, 2)}</cite><p>{self.sentences(1, 4)}</p></li>" for _ in range(r.randint(1, 5))) + f"</ol><form action=x><p>{w(2, 8)}</p><textarea>x</textarea><input type=submit></form>" if r.random() < 0.6 else ""
        title = f"<h2><a href=/>{self.mark(w(2, 9))}</a></h2>" if r.random() < 0.5 else f"<h2>{self.mark(w(2, 9))}</h2>"
        return f'<div id="head"><h1><a href="/">{w(1, 4)}</a></h1><span>{w(2, 8)}</span></div><div id="bar">{self.menu(2, 6)}</div><div id="content"><div class="post">{title}{"".join(self.prose(2, 10))}</div>{talk}</div><div id="side">{side}</div><div id="foot">{w(2, 10)} <a href=x>{w(1, 2)}</a></div>'

    def layout(self) -> str:
        r, w = self.r, self.words
        head = f"<tr><td colspan=2><font size=5>{w(1, 4)}</font></td></tr><tr><td colspan=2>{self.menu(3, 8)}</td></tr>"
        left = f"<td width={r.randint(100, 200)} valign=top>{r.choice((f'<b>{w(1, 2)}</b><br>', ''))}{self.menu(4, 12)}</td>"
        return f'<table width="100%" border=0>{head}<tr>{left}<td><h{(n := r.randint(1, 3))}>{self.mark(w(1, 9))}</h{n}>{"".join(self.prose(3, 12))}</td></tr><tr><td colspan=2 align=center><small>{w(2, 9)} &copy; {w(1, 2)}</small></td></tr></table>'

    def manual(self) -> str:
        r, w = self.r, self.words
        note = f'<div role="alert">{w(4, 14)} <a href=x>{w(1, 2)}</a></div>' if r.random() < 0.4 else ""
        return f'{note}<header role="banner"><a href="/">{w(1, 2)}</a><form role="search"><input><button>{w(1, 1)}</button></form></header><div class="grid"><nav class="toc"><p>{w(1, 2)}</p>{self.menu(5, 15)}</nav><main role="main"><h1>{self.mark(w(1, 6))}</h1>{"".join(self.prose(4, 16))}</main><aside class="on-this-page"><p>{w(2, 4)}</p>{self.menu(2, 7)}</aside></div><footer role="contentinfo"><p>{w(3, 12)}</p>{self.menu(1, 4)}</footer>'

    def bare(self) -> str:
        r, w = self.r, self.words
        top = f"<p>{self.menu(2, 6)}</p><hr>" if r.random() < 0.7 else ""
        end = f"<hr><p>{r.choice(('&copy; ', 'Copyright ', ''))}{w(1, 5)} {r.randint(1995, 2030)}</p>" if r.random() < 0.6 else ""
        return f'{top}<h1>{self.mark(w(1, 9))}</h1>{"".join(self.prose(3, 14))}{end}{self.menu(2, 5) if r.random() < 0.4 else ""}'

    def mixed(self) -> str:
        r = self.r
        some = lambda parts, p: "".join(self.other(x) for x in parts if r.random() < p)
        before = some(("notice",), 0.15) + some(("header",), 0.35) + some(("nav",), 0.8) + some(("ad",), 0.5) + some(("form", "nav", "notice"), 0.12)
        after = some(("share", "aside"), 0.2) + some(("comments",), 0.3) + some(("aside", "ad", "form", "notice"), 0.2) + some(("footer",), 0.85)
        body = before + f"<!-- {self.words(1, 3)} -->" + self.article() + after
        return f'<div id="{r.choice(("wrapper", "page", "container", "site"))}">{body}</div>' if r.random() < 0.2 else body

    def page(self, template: str) -> str:
        """A page; on one in four all class and id names mean nothing."""
        body = getattr(self, template)()
        if self.r.random() < 0.25:
            body = re.sub(r'(class|id|role)="[^"]*"', lambda m: f'{m[1]}="{self.r.choice("abcdefgh")}{self.r.randint(1, 99)}"', body)
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


TEMPLATES = ("mixed", "news", "mixed", "blog", "mixed", "layout", "mixed", "manual", "mixed", "bare")


def labelled_pages(n: int, seed: int = 20, templates: tuple[str, ...] = TEMPLATES) -> list[tuple[str, set[str]]]:
    """``n`` pages, by the templates in turn, and for each the texts of its main blocks; texts of other parts are never among them."""
    out = []
    for k in range(n):
        maker = Maker(seed * 1_000_003 + k)
        out.append((maker.page(templates[k % len(templates)]), maker.main))
    return out
