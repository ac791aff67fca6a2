SF001 = "/root/testdata/sf0.001"
