"""What to take from common kinds of pages: configurations for `extract`, by a kind's name. Own choices of widespread marks."""

from __future__ import annotations

#: Kind to field to selector; a plain selector lists texts, a mapping takes the first text or an attribute.
PRESETS: dict[str, dict[str, str | dict]] = {
    "article": {"title": {"selector": "h1"}, "author": {"selector": "[rel=author], .author, .byline"}, "published": {"selector": "time", "attr": "datetime"}, "paragraphs": "article p, main p", "tags": "[rel=tag], .tags a"},
    "blog": {"title": {"selector": "h1, .post-title"}, "posts": ".post h2, article h2", "links": {"selector": ".post a, article a", "attr": "href", "multiple": True}, "categories": ".category a, .categories a"},
    "product": {"name": {"selector": "h1, [itemprop=name]"}, "price": {"selector": "[itemprop=price], .price"}, "description": {"selector": "[itemprop=description], .description"}, "images": {"selector": ".gallery img, [itemprop=image]", "attr": "src", "multiple": True}},
    "listing": {"items": ".item, .listing li, .results li", "links": {"selector": ".item a, .listing a, .results a", "attr": "href", "multiple": True}, "next": {"selector": "[rel=next], .next a", "attr": "href"}},
    "forum": {"topic": {"selector": "h1, .topic-title"}, "posts": ".post, .message", "authors": ".post .author, .message .author", "dates": "time"},
    "job": {"title": {"selector": "h1, .job-title"}, "company": {"selector": ".company, [itemprop=hiringOrganization]"}, "place": {"selector": ".location, [itemprop=jobLocation]"}, "duties": ".responsibilities li, .description li"},
    "event": {"name": {"selector": "h1, [itemprop=name]"}, "starts": {"selector": "[itemprop=startDate], time", "attr": "datetime"}, "venue": {"selector": ".venue, [itemprop=location]"}},
    "recipe": {"name": {"selector": "h1, [itemprop=name]"}, "ingredients": "[itemprop=recipeIngredient], .ingredients li", "steps": "[itemprop=recipeInstructions] li, .instructions li"},
    "profile": {"name": {"selector": "h1, .profile-name"}, "about": {"selector": ".bio, .about"}, "links": {"selector": ".profile a, .social a", "attr": "href", "multiple": True}},
    "documentation": {"title": {"selector": "h1"}, "sections": "h2, h3", "code": "pre code", "contents": {"selector": "nav a, .toc a", "attr": "href", "multiple": True}},
}


def preset(kind: str) -> dict[str, str | dict]:
    """A copy of the configuration of a kind, to be changed freely."""
    if kind not in PRESETS:
        raise ValueError(f"no preset {kind}; there are {', '.join(sorted(PRESETS))}")
    return {field: dict(rule) if isinstance(rule, dict) else rule for field, rule in PRESETS[kind].items()}
