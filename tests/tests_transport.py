"""A transport for tests."""


def fake_pages(url, params):
    """A transport for tests: 5 records, two a page, the second page repeats a record."""
    if params["query"] == "broken" and params["offset"] >= 2:
        raise OSError("late failure")
    rows = [{"id": i} for i in (1, 2, 2, 3, 4)]
    return {"total": 5, "results": rows[params["offset"] : params["offset"] + params["size"]]}
