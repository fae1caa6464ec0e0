"""Where the tests find their tables."""

SF = "/root/testdata/sf0.001"
