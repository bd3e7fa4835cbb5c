"""Short forms of dates for literal frames."""

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days(start: str, count: int) -> list[dt.date]:
    return [day(start) + dt.timedelta(days=i) for i in range(count)]
