"""Places the tests read from."""

SF = "/root/testdata/sf0.001"
