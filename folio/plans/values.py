"""Rows for cases that the tables don't hold, as SQL that Spark and DuckDB both read."""

NAMES = "('a/b/Report.DOCX'), ('x.tar.gz'), ('.bashrc'), ('dir.d/file'), ('a.'), ('n.md'), ('n.JSONL'), ('p/q.ipynb'), ('t.tsv'), ('i.svg'), ('r.psd'), ('h.htm'), ('m.pdf'), ('d.pptx'), ('s.xlsx'), ('o.odp'), ('r.rtf'), ('c.cpp'), ('v.vim'), ('k.cmake'), ('Makefile'), ('Dockerfile'), ('z.abcdefghijklmnop'), ('z.abcdefghijklmno'), ('u.c++'), ('e.x y'), ('/')"
URLS = "('http://a/b'), ('HTTPS://a'), ('mailto:a@b'), ('javascript:alert(1)'), (' jAv' || chr(9) || 'aScript:x'), ('data:text/html,x'), ('ftp://x'), ('file:///etc'), ('/a:b'), ('#x:y'), ('?q=a:b'), ('docs/page.md'), (''), ('vbscript:x'), ('abcdefghijklmnopqrstuvwxyzabcdefghij:x'), ('//host/path'), ('java&#x09;script:x')"
REFS = "('A1'), ('Z9'), ('AA10'), ('XFD1'), ('ABCDE1'), ('a1'), ('1'), (''), ('BC'), ('IV65536')"
FORMATS = "(0, NULL), (9, NULL), (10, NULL), (14, NULL), (17, NULL), (18, NULL), (22, NULL), (45, NULL), (47, NULL), (48, NULL), (164, 'yyyy-mm-dd'), (165, 'hh:mm:ss'), (166, 'd/m/y h:mm'), (167, '0.0%'), (168, '\"day\" 0'), (169, '[h]'), (170, '#,##0'), (171, NULL), (172, 'mm')"
FORMAT_IDS = [0, 9, 10, 14, 17, 18, 22, 45, 47, 48, 164, 165, 166, 167, 168, 169, 170, 171, 172]
HEADS = ["255044462D312E34", "7B5C72746631", "89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "474946383861", "52494646000000005745425056", "424D000000000000000000000000000000000000000000000000", "424D00000000000000000000000000000000000000000000000000", "504B0304776F72642F646F63756D656E742E786D6C", "504B0304786C2F776F726B626F6F6B2E786D6C", "504B03047070742F70726573656E746174696F6E2E786D6C", "504B0304766E642E6F617369732E6F70656E646F63756D656E74", "504B030400", "00", "68656C6C6F", ""]
LINES = "('a;b,c;d'), ('a;b,c'), ('a,b'), ('\"x;y;z\",b'), ('a' || chr(9) || 'b'), ('a' || chr(9) || 'b,c'), (''), ('a;b;c' || chr(10) || ',,,,,,')"
SIZES = "(0), (1), (1023), (1024), (1280), (1331), (1536), (10239), (1048576), (1100000), (1073741824), (5000000000), (1099511627776), (9007199254740992)"
ANSI = "('a' || chr(27) || '[31mred' || chr(27) || '[0m b'), ('plain'), (chr(27) || '[1;4mx'), ('cut' || chr(27) || '['), ('[31m no escape')"
