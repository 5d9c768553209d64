"""Hand-made pages with their main text."""

import random

_WORDS = "the river ran past old mills while traders in the town counted bales of wool and told of roads that led far north".split()


def _text(seed, n):
    rng = random.Random(seed)
    w = [rng.choice(_WORDS) for _ in range(n)]
    return " ".join([f"K{seed}", *w]) + "."


MENU = "<ul>" + "".join(f'<li><a href="/{x}">{x.title()} news</a></li>' for x in ("world", "sport", "money", "arts", "tech")) + "</ul>"
P = [_text(i, 45 + 9 * i) for i in range(8)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in P[:4])
JOINED = "\n".join(P[:4])


def _records(open_, close, n=4):
    return "".join(f"{open_.format(i)}<span>Reader {i}</span><p>I think that {_text(90 + i, 18)}</p>{close}" for i in range(n))


#: (name, page, main text)
PAGES = [
    ("article", f"<body><header>Site</header><nav>{MENU}</nav><article><h1>Title here</h1>{PARAGRAPHS}</article><footer>Legal words</footer></body>", f"Title here\n{JOINED}"),
    ("article header", f"<body><nav>{MENU}</nav><article><header><h1>Title here</h1></header>{PARAGRAPHS}</article></body>", f"Title here\n{JOINED}"),
    ("entry header", f'<body><div class="site-header">Site name</div><article><div class="entry-header"><h1>Title here</h1></div>{PARAGRAPHS}</article></body>', f"Title here\n{JOINED}"),
    ("div article", f"<body><div>{MENU}</div><div>{PARAGRAPHS}</div><div>{MENU}</div></body>", JOINED),
    ("menu between", f"<body><article><p>{P[6]}</p><div>{MENU}</div><p>{P[7]}</p></article></body>", f"{P[6]}\n{P[7]}"),
    ("menu inside a div article", f"<body><div>{MENU}</div><div><p>{P[6]}</p>{MENU}<p>{P[7]}</p></div></body>", f"{P[6]}\n{P[7]}"),
    ("class comment-list", f'<body><div><p>{P[6]}</p><p>{P[7]}</p></div><div class="comment-list">{_records("<div>", "</div>")}</div></body>', f"{P[6]}\n{P[7]}"),
    ("id comments-section", f'<body><div><p>{P[6]}</p><p>{P[7]}</p></div><section id="comments-section">{_records("<div>", "</div>")}</section></body>', f"{P[6]}\n{P[7]}"),
    ("comments inside", f'<body><article><p>{P[6]}</p><p>{P[7]}</p><div class="comment-list">{_records("<div>", "</div>")}</div></article></body>', f"{P[6]}\n{P[7]}"),
    ("class comments", f'<body><div><p>{P[6]}</p><p>{P[7]}</p></div><div class="comments">{_records("<div>", "</div>", 8)}</div></body>', f"{P[6]}\n{P[7]}"),
    ("unnamed comments", f'<body><div><p>{P[6]}</p><p>{P[7]}</p></div><div class="x7">{_records("<div class=c{}>", "</div>")}</div></body>', f"{P[6]}\n{P[7]}"),
    ("unnamed comments inside", f'<body><div><p>{P[5]}</p><p>{P[6]}</p><p>{P[7]}</p><div class="x7">{_records("<div class=c{}>", "</div>", 5)}</div></div></body>', "\n".join(P[5:8])),
    ("nested comment articles", f'<body><article>{PARAGRAPHS}<section>{_records("<article class=comment>", "</article>", 3)}</section></article></body>', JOINED),
    ("cookie bar", f'<body><div class="cookie-bar"><p>{_text(70, 60)}</p></div><div class="post">{PARAGRAPHS}</div></body>', JOINED),
    ("sections", "<body><div>" + "".join(f"<section><h2>Part {i}</h2><p>{P[i]}</p></section>" for i in range(4)) + "</div></body>", "\n".join(f"Part {i}\n{P[i]}" for i in range(4))),
    ("marked wrapper", f'<body><div class="layout sidebar"><main>{PARAGRAPHS}</main></div></body>', JOINED),
    ("list in the text", f"<body><article><p>{P[5]}</p><ul><li>{P[1]}</li><li>{P[2]}</li></ul><p>See <a href=x>one</a> and <a href=y>two</a> of {P[3]}</p></article></body>", f"{P[5]}\n{P[1]}\n{P[2]}\nSee one and two of {P[3]}"),
    ("quotes", f"<body><nav>{MENU}</nav><div><p>{P[4]}</p><blockquote><p>{P[2]}</p></blockquote><p>{P[5]}</p></div><div class='related'>{MENU}</div></body>", f"{P[4]}\n{P[2]}\n{P[5]}"),
]
