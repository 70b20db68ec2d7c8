"""Two small sites with planted differences, written anew for these tests."""

from __future__ import annotations

NAV = {"A": [("/", "Home"), ("/products/", "Products"), ("/team.html", "Team"), ("/about-us/", "About"), ("/blog/", "Blog"), ("/pricing/", "Pricing"), ("/faq/", "FAQ"), ("/contact/", "Contact"), ("/careers/", "Careers"), ("/private/", "Members")]}
NAV["B"] = [("/", "Home"), ("/products/", "Products"), ("/team/", "Team"), ("/about/", "About"), ("/blog/", "News"), ("/plans/", "Pricing"), ("/faq/", "FAQ"), ("/contact/", "Contact"), ("/downloads/", "Downloads"), ("/private/", "Members")]


def page(site: str, title: str, body: str, head: str = "") -> str:
    nav = "".join(f'<li><a href="{u}">{t}</a></li>' for u, t in NAV[site])
    year = {"A": 2025, "B": 2026}[site]
    return f"""<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title>{head}
<script>track("</p>")</script></head><body><header><img src="/img/logo.{'a1b2c3d4' if site == 'A' else 'ffee9911'}.png" alt="Pinewood Kettles logo"><nav><ul>{nav}</ul></nav></header>
<main>{body}</main><footer><p>&copy; {year} Pinewood Kettles. Built for people who take their tea seriously.</p></footer></body></html>"""


ABOUT = "<h1>About Pinewood</h1><p>Pinewood began in a shed by the river where two brothers hammered copper pots for the village market.</p><p>Today {n} people cast, polish and test every kettle by hand before it leaves the workshop door.</p><p>We repair whatever we have ever sold, however old it is, and we plant a tree for each kettle that comes back.</p>"


def sites() -> list[tuple]:
    """Rows (site, path, status, redirect_to, content_type, html, error)."""
    out = []

    def put(site, path, title, body, head=""):
        out.append((site, path, 200, None, "text/html", page(site, title, body, head), None))

    put("A", "/", "Kettles For Everyone", """<h1>Kettles for everyone</h1><p>We have sold over 10,000 kettles to happy homes since we opened.</p>
      <h2>Why choose us</h2><ul><li>Free returns within sixty days of purchase</li><li>Phone support every day of the week</li></ul>
      <h2>Latest news</h2><img src="/img/award-2024.png" alt="Design award 2024"><img src="/img/hero-800x600.jpg" alt="A copper kettle on a stove"><a class="btn" href="/contact/">Get a quote</a>""")
    put("B", "/", "Kettles for everyone", """<h1>Kettles for everyone</h1><p>We have sold over 12,000 kettles to happy homes since we opened.</p>
      <h3>Why choose us</h3><ul><li>Free returns within sixty days of purchase</li></ul><p>You can now track your delivery on a map in real time.</p>
      <h2>Latest updates</h2><img src="/img/hero-1024x768.jpg" alt="A kettle"><a class="btn" href="/contact/">Request a quote</a>""")
    for s, price, table, robots, utm in (("A", "49.99", "<table><tr><td>Size</td><td>Weight of the kettle</td></tr></table>", "", "old"), ("B", "59.99", "", '<meta name="robots" content="noindex">', "new")):
        put(s, "/products/", "Products", f'<h1>Products</h1><p>The small kettle costs ${price} with delivery.</p>{table}<p>Find a <a href="https://partner.example.org/shop?utm_source={utm}&id=3">dealer near your home</a>.</p>', robots)
    for s, required, extra, button in (("A", "", '<label>Phone <input name="phone"></label>', "Send"), ("B", "required", '<label>Company <input name="company"></label>', "Send message")):
        put(s, "/contact/", "Contact", f'<h1>Contact</h1><form action="/send" method="post"><input type="hidden" name="csrf" value="{s}1"><label for="m">Email</label><input id="m" name="email" type="email" {required}>{extra}<button>{button}</button></form>')
    for s, q, when, sid, n in (("A", "1", "2026-01-02 10:11:12", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "  "), ("B", "2", "2026-03-04 01:02:03", "9b1deb4d-3b7d-4bad-9bdd-2b0d7b3dcb6d", "\n")):
        put(s, "/faq/", "Questions", f'<h1>Questions</h1><!-- {s} --><p id="x{q}">How long does a{n}kettle last? Many decades.</p><p>Generated at {when} in session {sid} for you.</p><img src="/img/steam.png?v={q}" alt="Steam">')
    for s, day in (("A", 3), ("B", 4)):
        put(s, "/blog/first-post/", "First post", f"<h1>First post</h1><p>Posted March {day}, 2026 by the workshop team.</p><p>We are proud to show our very first kettle to the world.</p>")
    put("A", "/blog/", "Blog", '<h1>Blog</h1><p>Stories from the workshop and from the road.</p><a href="/blog/first-post/">Read the first post</a>')
    put("B", "/blog/", "Blog", '<h1>News</h1><p>Stories from the workshop and from the road.</p><a href="/blog/first-post/">Read the first post</a> <a href="/blog/new-post/">Read the new post</a>')
    put("B", "/blog/new-post/", "New post", "<h1>New post</h1><p>Our shop in the harbour opens with music and free samples on Saturday.</p>")
    put("A", "/pricing/", "Pricing", "<h1>Pricing</h1><p>Membership costs $9 per month and includes repairs.</p><p>Cancel at any time by letter or by phone.</p>")
    put("B", "/plans/", "Pricing", "<h1>Pricing</h1><p>Membership costs $12 per month and includes repairs.</p><p>Cancel at any time by letter or by phone.</p>")
    out.append(("B", "/pricing", 301, "/plans/", None, None, None))
    put("A", "/about-us/", "About us", ABOUT.format(n=120))
    put("B", "/about/", "About us", ABOUT.format(n=150))
    team = "<h1>Team</h1><p>Ada leads the casting hall and Bert keeps the furnaces burning.</p>"
    put("A", "/team.html", "Team", team)
    put("B", "/team/", "Team", team)
    put("A", "/careers/", "Careers", "<h1>Careers</h1><p>We look for a polisher with patience and strong arms for our northern workshop.</p>")
    for s in "AB":
        put(s, "/private/", "Members", "<h1>Members</h1><p>Only for members of the club.</p>")
    return out


ROBOTS = {"A": [("/private/", False)], "B": [("/private/", False)]}
