"""Names of TLS settings in a configuration and the numbers that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The numbers of the TLS registry (versions, cipher suites, groups) and the order of the client certificate policies.
PROTOCOLS = {"ssl3.0": 0x0300, "tls1.0": 0x0301, "tls1.1": 0x0302, "tls1.2": 0x0303, "tls1.3": 0x0304}
CURVES = {"P256": 23, "P384": 24, "P521": 25, "X25519": 29}
CLIENT_AUTH = {"NoClientCert": 0, "RequestClientCert": 1, "RequireAnyClientCert": 2, "VerifyClientCertIfGiven": 3, "RequireAndVerifyClientCert": 4}
CIPHERS = {
    "TLS_RSA_WITH_RC4_128_SHA": 0x0005, "TLS_RSA_WITH_3DES_EDE_CBC_SHA": 0x000A, "TLS_RSA_WITH_AES_128_CBC_SHA": 0x002F, "TLS_RSA_WITH_AES_256_CBC_SHA": 0x0035,
    "TLS_RSA_WITH_AES_128_CBC_SHA256": 0x003C, "TLS_RSA_WITH_AES_128_GCM_SHA256": 0x009C, "TLS_RSA_WITH_AES_256_GCM_SHA384": 0x009D,
    "TLS_AES_128_GCM_SHA256": 0x1301, "TLS_AES_256_GCM_SHA384": 0x1302, "TLS_CHACHA20_POLY1305_SHA256": 0x1303, "TLS_FALLBACK_SCSV": 0x5600,
    "TLS_ECDHE_ECDSA_WITH_RC4_128_SHA": 0xC007, "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA": 0xC009, "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA": 0xC00A, "TLS_ECDHE_RSA_WITH_RC4_128_SHA": 0xC011,
    "TLS_ECDHE_RSA_WITH_3DES_EDE_CBC_SHA": 0xC012, "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA": 0xC013, "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA": 0xC014,
    "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256": 0xC023, "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256": 0xC027, "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256": 0xC02B, "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384": 0xC02C,
    "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256": 0xC02F, "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384": 0xC030, "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305": 0xCCA8, "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305": 0xCCA9,
}


def dimension(spark: SparkSession) -> DataFrame:
    """kind, name and number of every known setting."""
    rows = [(kind, name, n) for kind, of in (("protocol", PROTOCOLS), ("curve", CURVES), ("client_auth", CLIENT_AUTH), ("cipher", CIPHERS)) for name, n in of.items()]
    return spark.createDataFrame(rows, "kind string, name string, number int")


def numbered(settings: DataFrame) -> DataFrame:
    """Rows with kind and name, and their number; unknown names are left out. The dimension is a constant of some forty rows."""
    return settings.join(F.broadcast(dimension(settings.sparkSession)), ["kind", "name"])
