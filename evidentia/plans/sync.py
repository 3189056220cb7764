"""What a report service is sent and answers: built and validated here, never sent."""

from __future__ import annotations

from urllib.parse import urlsplit

from .report import is_int, is_time, is_uuid, need, validate


def request(report: dict) -> dict:
    return {"report": validate(report)}


def response(answer: dict) -> dict:
    """scanId, dashboardUrl and, if the service knows an earlier scan, delta."""
    need(isinstance(answer, dict) and is_uuid(answer.get("scanId")), "an answer has a scanId")
    url = urlsplit(answer["dashboardUrl"]) if isinstance(answer.get("dashboardUrl"), str) else None
    need(url is not None and bool(url.scheme) and bool(url.netloc), "an answer has a dashboardUrl")
    if "delta" in answer:
        need(isinstance(answer["delta"], dict) and is_int(answer["delta"].get("previousScore"), 0, 100) and is_time(answer["delta"].get("previousScanAt")), "delta has a score and a time")
    return answer
