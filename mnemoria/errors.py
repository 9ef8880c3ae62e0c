"""Errors with codes. The codes and the HTTP status that a front end gives for each."""

from __future__ import annotations

STATUS = {
    "AUTH_INVALID_KEY": 401, "AUTH_MISSING_KEY": 401, "AUTH_INSUFFICIENT": 403,
    "MISSING_CONFIG": 500, "MISSING_ENV_VAR": 500, "MISSING_DEPENDENCY": 500,
    "TRANSPORT_CONNECTION": 502, "TRANSPORT_TIMEOUT": 504, "TRANSPORT_REFUSED": 502,
    "TIMEOUT_LLM": 504, "TIMEOUT_CHROMA": 504, "TIMEOUT_PIPELINE": 504,
    "STORAGE_WRITE_FAILED": 500, "STORAGE_READ_FAILED": 500, "STORAGE_DUPLICATE": 409, "STORAGE_CONSISTENCY": 500,
    "PIPELINE_STAGE_FAILED": 500, "PIPELINE_STAGE_NOT_FOUND": 500, "PIPELINE_BUFFER_OVERFLOW": 503,
    "VALIDATION_INVALID_PARAM": 400, "VALIDATION_MISSING_PARAM": 400,
    "EMPTY_RESULTS": 404, "EMPTY_CONTENT": 400, "RATE_LIMITED": 429,
}


class StoreError(Exception):
    """An error with a code of STATUS, as a dictionary for callers that answer requests."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.status = code, message, STATUS[code]

    def to_dict(self) -> dict:
        return {"error": {"code": self.code, "message": self.message}, "status": self.status}
