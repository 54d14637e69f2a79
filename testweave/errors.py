"""Typed errors; ``code`` is stable, for callers that branch on it."""


class HistoryError(Exception):
    code = "error"


class ReportParseError(HistoryError, ValueError):
    code = "report_parse"


class NoReportsError(HistoryError):
    code = "no_reports"


class TestNotFoundError(HistoryError):
    code = "test_not_found"


class ConfigError(HistoryError):
    code = "config"


class EmptyReportError(ReportParseError):
    code = "report_empty"


class BrowserReportError(ReportParseError):
    code = "browser_report_parse"


class StoreVersionError(HistoryError):
    code = "history_io"
