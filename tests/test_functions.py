import pytest
from pyspark.sql import functions as F

from meshlens.functions import identity as I
from meshlens.functions import paths as P
from meshlens.functions import predicates as R

UNARY = {
    "normalize_path": (P.normalize_path, [
        ("/v1/orders/{id}", "/v1/orders/{}"), ("/v1/orders/${id}", "/v1/orders/{}"), ("/v1/orders/:orderId/items", "/v1/orders/{}/items"), ("/users/<int:id>", "/users/{}"),
        ("orders/123", "/orders/{}"), ("/o/9f8b1c2d3e4a5b6c", "/o/{}"), ("V1/Orders", "/v1/orders"), ("", "/"), (None, "/"), ("https://x.internal/v1/charge", "/v1/charge"),
        ("/search?q=1#top", "/search"), ("/user-${id}/x", "/{}/x"), ("//a//b/", "/a/b"),
    ]),
    "normalize_identity": (I.normalize_identity, [
        ("https://payments-svc.internal/v1/charge", "payments"), ("payment-service", "payment"), ("$ENV:USER_SERVICE_URL", "user"), ("order-management-service", "order-management"),
        ("api-gateway", "api-gateway"), (None, ""), ("Billing.API.com:8080", "billing"),
    ]),
    "stem": (I.stem, [("payments", "payment"), ("bus", "bus"), ("order-items", "order-item"), (None, "")]),
    "service_from_url": (I.service_from_url, [("https://payments-service.internal/v1", "payments-service"), ("$ENV:USER_URL", "USER_URL"), ("/only/path", "/only/path")]),
    "import_name": (I.import_name, [("com.company.payments.Client", "payments"), ("client", "client"), ("a.b", "b")]),
    "slug": (I.slug, [("My Repo_1!", "my-repo-1")]),
    "resolve_placeholder": (R.resolve_placeholder, [("${CTX:/pss}", "/pss"), ("${CTX}", ""), ("/a/${B}", ""), ("'/x'", "/x"), (None, "")]),
    "is_value_holder": (R.is_value_holder, [("com.a.PnrConstants", True), ("a/b/types", True), ("com.a.PaymentClient", False), ("", False), (None, False)]),
    "is_namespace_noise": (R.is_namespace_noise, [("http://www.w3.org/2001/XMLSchema", True), ("https://schemas.xmlsoap.org:80/x", True), ("https://orders.internal", False), (None, False)]),
    "basename": (P.basename, [("a\\b/c.java", "c.java"), (None, "")]),
}


@pytest.mark.parametrize("name", UNARY)
def test_unary(spark, name):
    f, cases = UNARY[name]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == [y for _, y in cases]


def test_endpoint_key_and_split(spark):
    rows = [("get", "/v1/users/{id}", "GET /v1/users/{}"), ("", "/x", "ANY /x"), (None, "/x", "ANY /x")]
    got = spark.createDataFrame(rows, "m string, p string, want string").select(P.endpoint_key(F.col("m"), F.col("p")).alias("k"), "want").collect()
    assert all(r.k == r.want for r in got)
    rows = [("https://payments.internal/v1/charge", "payments.internal", "/v1/charge"), ("/v1/charge", "", "/v1/charge"), ("https://payments.internal", "payments.internal", "/"), ("$ENV:HOST/x", "HOST", "/x"), ("{base}/x", "", "/x"), ("a.b:80/c/d", "a.b:80", "/c/d"), ("plain/x", "", "/plain/x"), (None, "", "/")]
    s = P.split_host_path(F.col("u"))
    got = spark.createDataFrame(rows, "u string, h string, p string").select(s["host"].alias("host"), s["path"].alias("path"), "h", "p").collect()
    assert all((r.host, r.path) == (r.h, r.p) for r in got)


def test_confidences(spark):
    got = [r.c for r in spark.range(5).select(R.fanout_confidence(F.col("id")).alias("c")).collect()]
    assert got == [0.9, 0.75, 0.6, 0.45, 0.4]
