import pytest
from pyspark.sql import functions as F

from hireloom.sources.pages import blocked_reason

LONG = "p{margin:0}" * 3000


@pytest.mark.parametrize(
    ("html", "reason"),
    [
        (f"<!DOCTYPE html><html><head><meta charset=utf-8><style>{LONG}</style><script>{LONG}</script></head><body><p>Access <b>denied</b></p></body></html>", "access-denied"),
        (f"<head><style>{LONG}</style><title>Captcha</title></head><body>x</body>", "captcha"),
        (f"<script>{LONG}</script><!-- </head><body> -->Please sign in to continue", "login"),
        ("<head><script>var a = 'captcha';</script><style>.captcha{}</style></head><body>Jobs</body>", None),
        ("<body><script>captcha()</script></body>", "captcha"),
        (f"<body>{'x' * 20_000} captcha</body>", None),
        (None, None),
    ],
)
def test_title_and_body_are_read(spark, html, reason):
    assert spark.createDataFrame([(html,)], "html string").select(blocked_reason(F.col("html")).alias("r")).first().r == reason
