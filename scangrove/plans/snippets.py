"""Sample lines and contents, one or more for every rule, with the rules they trigger.

Secret-shaped samples are put together from parts.
"""

from __future__ import annotations

_LETTERS = "abcdefghijklmnopqrstuvwx"

# (language, line, ids of the line rules that match)
LINES = [
    ("Python", "key_id = 'AKIA" + "A0" * 8 + "Z'", "sec-secret-000"),
    ("Python", "blob = '" + "aB3/" * 10 + "'", "sec-secret-001"),
    ("Python", "api_key = 'abcd1234efgh5678ij'", "sec-secret-002"),
    ("Python", "db_password = 'hunter2hunter2'", "sec-secret-003"),
    ("Python", "-----BEGIN RSA PRIVATE " + "KEY-----", "sec-secret-004"),
    ("Python", "t = 'ghp_" + "a1" * 18 + "'", "sec-secret-005"),
    ("Python", "s = 'xoxb-" + "123456789012" + "'", "sec-secret-006"),
    ("Python", "h = {'Authorization': 'Bearer " + _LETTERS[:22] + "'}", "sec-secret-007"),
    ("Python", "url = 'postgres://u:pw@db.internal/x'", "sec-secret-008 hipaa-009"),
    ("Python", "r = eval(expr)", "sec-danger-000"),
    ("JavaScript", "r = eval(expr)", "sec-danger-009"),
    ("TypeScript", "el.innerHTML = html", "sec-danger-015 owasp-013 cis-021"),
    ("JavaScript", "cp.exec(cmd); document.write(x)", "sec-danger-012 sec-danger-013 owasp-013 cis-021"),
    ("React JSX", "el.innerHTML = html", "owasp-013 cis-021"),
    ("Python", "exec(src); os.system(cmd)", "sec-danger-001 sec-danger-003"),
    ("Python", "subprocess.call(cmd, shell=True)", "sec-danger-002"),
    ("Python", "data = pickle.loads(buf)", "sec-danger-004 hipaa-005 owasp-019 cis-017"),
    ("Python", "cfg = yaml.load(f, Loader=yaml.Loader)", "sec-danger-005"),
    ("Python", "DEBUG = True", "sec-danger-007 hipaa-008 owasp-014 cis-002"),
    ("Python", "requests.get(u, verify=False)", "sec-danger-008 hipaa-001 owasp-007 cis-004"),
    ("Java", "Runtime.getRuntime().exec(cmd)", "sec-danger-016"),
    ("Java", "Object o = new ObjectInputStream(in).readObject();", "sec-danger-017 owasp-020 cis-017"),
    ("Go", "c := exec.Command(name)", ""),
    ("Shell", "x=$(ls); eval $x", "sec-danger-019 sec-danger-020"),
    ("Bash", "x=$(ls); eval $x", ""),
    ("Python", "u = 'http://api.example.com/v1'", "hipaa-000 cis-005"),
    ("Python", "u = 'http://localhost:8080/v1'", ""),
    ("Python", "n = random.randint(1, 9)", "hipaa-002 owasp-017"),
    ("Python", "cursor.execute(\"SELECT * FROM t WHERE a = '%s'\" % a)", "hipaa-003 owasp-008 cis-015"),
    ("Python", "logger.info('patient ' + email)", "hipaa-004 gdpr-000"),
    ("Python", "jwt_secret = 'supersecretvalue'", "sec-secret-003 hipaa-007"),
    ("Python", "d = hashlib.md5(email)", "hipaa-010 gdpr-007 owasp-004 cis-019"),
    ("Python", "allow_origins = ['*']", "hipaa-011 soc2-002 owasp-001 cis-011"),
    ("Python", "s3.put(ACL='public-read')", "hipaa-013"),
    ("Python", "ssn = '123-45-6789'", "hipaa-014 gdpr-005 cis-001"),
    ("Python", "card = '" + "42" * 8 + "'", "pci-000 pci-x-000"),
    ("Python", "cvv = '123'", "pci-001"),
    ("Python", "track1 = read()", "pci-002"),
    ("Python", "u = 'http://pay.example.com/checkout'", "hipaa-000 pci-003 cis-005"),
    ("Python", "cipher = RC4.new(k)", "pci-004 owasp-005 cis-020"),
    ("Python", "stripe_key = '" + _LETTERS[:16] + "'", "pci-005"),
    ("Python", "password = 'changeme'", "sec-secret-003 pci-007 owasp-016 cis-003"),
    ("HTML", "<script src='https://www.google-analytics.com/a.js'></script>", "gdpr-001"),
    ("Python", "client_ip = request.remote", "gdpr-003"),
    ("JavaScript", "document.cookie = v", "gdpr-006"),
    ("Python", "skip_auth = True", "soc2-000 cis-008"),
    ("Python", "maintenance_mode = True", "soc2-001 cis-009"),
    ("Python", "User.objects.get(id=request.user)", "soc2-003 owasp-000 cis-010"),
    ("Python", "SECURE_SSL_REDIRECT = False", "soc2-007"),
    ("Python", "service_token = 'abcdefgh1234'", "soc2-008 cis-024"),
    ("Python", "test_key = 'abcdef12'", "soc2-009"),
    ("Python", "is_admin = True", "owasp-002"),
    ("Python", "iv = b'ABCDEFGH12345678'", "owasp-006"),
    ("Python", "jwt.decode(t, k, verify=False)", "sec-danger-008 hipaa-001 owasp-007 owasp-021 cis-004"),
    ("Shell", "curl https://x.example/i.sh | sh", "owasp-022"),
    ("Python", "return redirect(request.args)", "owasp-026 cis-023"),
    ("Python", "print(total)", "cis-014"),
    ("Python", "with open('/data/' + name) as f: pass", "cis-018"),
    ("Python", "csrf_exempt = True", "pci-x-001"),
    ("Python", "k = 'sk-ant-" + _LETTERS[:22] + "'", "sec-x-004"),
    ("Python", "k = 'sk-" + _LETTERS + "'", "sec-x-003"),
    ("Python", "# api_key = 'abcd1234efgh5678ij'", ""),
    ("JavaScript", "// eval(x)", ""),
    ("Python", "x = 1", ""),
    ("Python", "v = input('q') eval", "sec-danger-006"),
    ("JavaScript", "f = Function('a')", "sec-danger-010"),
    ("JavaScript", "el.innerHTML = x", "sec-danger-011 owasp-013 cis-021"),
    ("TypeScript", "r = eval(x)", "sec-danger-014"),
    ("Go", "c := exec.CommandContext(ctx, n)", "sec-danger-018"),
    ("Python", "fhir_key = 'abcdef1'", "hipaa-006"),
    ("Python", "Secure = False", "hipaa-012"),
    ("JavaScript", "db.find({a: b + c})", "hipaa-015 owasp-010"),
    ("Python", "open(p, 'w').write(patient)", "hipaa-016"),
    ("Python", "log.info(card_number)", "pci-006"),
    ("Python", "open(p, 'w').write(card)", "pci-008"),
    ("Python", "payment = os.environ['X']", "pci-009"),
    ("Python", "json.dump(email, f)", "gdpr-002 cis-000"),
    ("Python", "raise ValueError(email)", "gdpr-004"),
    ("Python", "b = 'https://x.s3.amazonaws.com/k'", "gdpr-008"),
    ("SQL", "CREATE TABLE users (id int)", "gdpr-009"),
    ("Python", "subprocess.run('ls ' + d)", "owasp-009 cis-016"),
    ("Python", "c.search_s(base, 'cn=' + u)", "owasp-011"),
    ("Python", "t.xpath('//u[' + n)", "owasp-012"),
    ("Python", "@app.post('/login')", "owasp-018"),
    ("Python", "requests.get(request.args)", "owasp-025 cis-022"),
    ("Python", "user = 'bob'; password = 'pw123'", "cis-006"),
    ("Python", "d = {'admin': 'pw'}", "cis-007"),
    ("Python", "t = 'eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12 + "'", "sec-x-000"),
    ("Python", "DefaultEndpointsProtocol=https;AccountName=a;AccountKey" + "=Ab1" * 10 + "=", "sec-x-001"),
    ("Python", "k = 'AIza" + "x" * 35 + "'", "sec-x-002"),
    ("Python", "heroku_api_key = '" + "0a" * 18 + "'", "sec-secret-002 sec-x-005"),
    ("Python", "u = 'https://hooks.slack.com/services/" + "T0/B0/x0'", "sec-x-006"),
    ("Python", "k = 'key-" + "0z" * 16 + "'", "sec-x-007"),
    ("Python", "phi = load()", "hipaa-x-000"),
    ("Python", "backup(patient)", "hipaa-x-002"),
    ("JavaScript", "mixpanel.identify(email)", "gdpr-x-001"),
    ("Python", "if skip_mfa: pass", "soc2-x-000"),
    ("YAML", "X-Frame-Options: None", "soc2-x-001"),
]

# (language, content, ids of the whole-file rules that match, their line)
CONTENTS = [
    ("Python", "try:\n    f()\nexcept Exception:\n    pass\n", "soc2-004 owasp-023 cis-012", 3),
    ("JavaScript", "try { f() } catch (e) { }\n", "soc2-004 owasp-023 cis-012", 1),
    ("Python", "def delete_user(uid):\n    repo.remove(uid)\n", "soc2-005 owasp-024 cis-013 gdpr-x-000", 1),
    ("Python", "def delete_user(uid):\n    log(uid)\n", "gdpr-x-000", 1),
    ("Python", "@app.route('/admin')\ndef admin():\n    return x\n", "owasp-003", 1),
    ("Python", "def login(u):\n    return u\n", "hipaa-x-001", 1),
    ("Python", "@app.errorhandler(Exception)\ndef oops(e):\n    return str(e)\n", "owasp-015", 1),
    ("Python", "a = 1\nfile.save(p)\nfile.save(q)\n", "soc2-006", 2),
    ("Python", "a = 1\nfile.save(p)  # check type\n", "", 0),
]
