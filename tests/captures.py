"""Synthetic captures, built in code."""

import json

SECRETS = ["S3CRET-HEADER", "S3CRET-COOKIE", "S3CRET-QUERY", "S3CRET-POST", "S3CRET-BODY", "S3CRET-TITLE", "S3CRET-USER", "S3CRET-MAIL@example.com", "S3CRET-VERSION", "S3CRET-METHOD", "S3CRET-MIME"]


def entry(k: int, page: str = "p1", **changes) -> dict:
    made = {
        "pageref": page, "startedDateTime": f"2024-03-0{k % 9 + 1}T10:00:{k % 60:02d}.123456789+02:00", "time": 100.0 + k,
        "request": {"method": "GET", "url": f"https://S3CRET-USER:pw@Host{k}.example.com:8443/a/{k}/S3CRET-MAIL@example.com?q=S3CRET-QUERY#x", "headers": [{"name": "Cookie", "value": "S3CRET-HEADER"}], "cookies": [{"name": "s", "value": "S3CRET-COOKIE"}], "postData": {"text": 'S3CRET-POST "entries": [ é'}, "bodySize": -1},
        "response": {"status": 200, "content": {"size": 1000 + k, "mimeType": "text/html; S3CRET-MIME", "text": "S3CRET-BODY"}, "bodySize": 500 + k},
        "timings": {"blocked": -1, "dns": 1.5, "connect": 2, "ssl": -1, "send": 0, "wait": 90, "receive": 6.5},
    }
    return made | changes


def capture(n: int = 5, pages_last: bool = False, **changes) -> dict:
    page = {"id": "p1", "startedDateTime": "2024-03-01T10:00:00.000Z", "title": 'S3CRET-TITLE "entries": [ 漢字', "pageTimings": {"onContentLoad": 120.5, "onLoad": -1}}
    entries = [entry(k) for k in range(n)]
    parts = {"entries": entries, "pages": [page]} if pages_last else {"pages": [page], "entries": entries}
    return {"log": {"version": "1.2", "creator": {"name": "x", "note": '"log": {'}, **parts, **changes}}


ENCODINGS = [lambda c: json.dumps(c, separators=(",", ":"), ensure_ascii=False), lambda c: json.dumps(c, ensure_ascii=False), lambda c: json.dumps(c, indent=2, ensure_ascii=True)]
