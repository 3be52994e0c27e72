from blockloom.llm import warc


def test_long_header():
    def record(k, extra):
        body = b"body %d" % k
        return b"WARC/1.1\r\nX-Long: " + b"y" * extra + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    records = [record(0, 5), record(1, 70_000), record(2, 200_000), record(3, 5)]
    assert [r for _, r in warc.parse_warc(b"".join(records))] == records
    cut = records[0] + b"WARC/1.1\r\nno end"
    assert [r for _, r in warc.parse_warc(cut)] == [records[0], b"WARC/1.1\r\nno end"]
